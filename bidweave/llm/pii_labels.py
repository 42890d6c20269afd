"""A small labelled table for the tagger of personal details, built from a seed.

Each row is a sentence or two of the trade's plain prose with details, or with things that look like details and are
none, in places and spellings a reader would know. People and places are put together from syllables, so the tagger has
to go by shape and company, not by memory; telephone numbers and domains are those set aside for examples.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

LABELS = ("O", "name", "email", "phone", "id_number", "address")

# Given names in common use; the tagger knows them as such.
GIVEN = frozenset(
    "aaron abel ada adam agnes ahmed aisha alan albert alex alice alma amina amir amos ana andre andrew anna anton april arun astrid aziz beatrice ben bruno carl carla carlos "
    "carmen cecilia chen chloe clara claude daniel dario david dele dennis diana diego dina dora edgar elena elin elisa emil emma eric erik esther eva farid fatima felix fiona "
    "frank gabriel george gita grace greta hana hans hassan hector helen henry hugo ian ibrahim igor ines ingrid irene isaac ivan jacob james jana jane jean jin joan john jonas jorge "
    "jose joseph joyce julia karen karim kemal kenji kofi kurt laila lars laura leila leo lina linda lucas lucia luis maria marco marek maria mark marta martin mary mateo maya "
    "mei michael miguel mina mohamed nadia nina noor nora olga omar oscar otto owen pablo paul pedro peter petra pierre priya rafael rahul ravi rita robert rosa ruth samir samuel "
    "sara sofia stefan susan tariq thomas tomas uma vera victor viktor wanda wei yara yusuf zara zoe".split())

_ON = "b br c cl cr d dr f fl fr g gl gr h j k kl kr l m n p pl pr qu r s sk sl sp st str t th tr v w z zh".split()
_VO = "a e i o u ae ai ea ei ia io oa ou ui".split()
_CO = "n l r m s t d x k b g lt nd rn sk ck ss th ft mp".split()


class _Words:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, items):
        return self.r.choice(items)

    def syllables(self, least: int = 2, most: int = 3) -> str:
        n = self.r.randint(least, most)
        return "".join(self.pick(_ON) + self.pick(_VO) + (self.pick(_CO) if self.r.random() < 0.5 else "") for _ in range(n))

    def proper(self, **k) -> str:
        return self.syllables(**k).capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letter(self) -> str:
        return self.r.choice("ABCDEFGHIJKLMNOPRSTVWZ")


_GIVEN = sorted(GIVEN)
_ROLES = ("evaluation chair", "grants analyst", "contracting officer", "program manager", "data steward", "safety inspector", "procurement specialist", "site supervisor", "product owner", "legal counsel",
          "technical monitor", "fiscal agent", "records custodian", "quality lead", "field coordinator", "transition lead", "privacy reviewer", "facility engineer", "buyer", "project lead")
_NOUNS = "ledger turbine registry pump harness bridge sample workbook server firmware orchard parcel culvert docket transcript fleet panel lumber vaccine concrete kiosk voucher schedule chart".split()
_ADJ = "annual federal modular redacted portable digital seasonal structural alternate fiscal optical urban original bonded monthly".split()
_FORMS = ("key personnel form", "compliance crosswalk", "risk register", "signature page", "bid bond form", "cost template", "past performance form", "quality plan", "reference sheet", "insurance rider", "conflict disclosure", "equipment list", "subcontracting plan")
_VERBS = "inspect deliver report seal repair publish survey store calibrate translate review archive".split()


def _surname(w: _Words) -> str:
    s = w.proper()
    x = w.r.random()
    if x < 0.12:
        return s + "-" + w.proper()
    if x < 0.17:
        return w.pick(["de ", "van ", "von ", "da ", "O'", "al-"]) + s
    return s


def name(w: _Words) -> str:
    given, last = w.pick(_GIVEN).capitalize(), _surname(w)
    if w.r.random() < 0.06:
        given = w.proper(least=1, most=2)
    form = w.r.random()
    if form < 0.26:
        out = f"{given} {last}"
    elif form < 0.38:
        out = f"{given} {w.letter()}. {last}"
    elif form < 0.5:
        out = f"{w.letter()}. {last}"
    elif form < 0.62:
        out = f"{last}, {given}"
    elif form < 0.76:
        out = f"{w.pick(['Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'Mr', 'Ms', 'Herr', 'Mme', 'Sr.'])} {last}"
    elif form < 0.82:
        out = f"{w.pick(['Mr.', 'Mrs.', 'Ms.', 'Dr.'])} {given} {last}"
    elif form < 0.92:
        out = f"{given} de {last}" if w.r.random() < 0.5 and " " not in last else f"{given} {last}"
    else:
        out = f"{w.letter()}. {w.letter()}. {last}"
    if w.r.random() < 0.2:
        out = out.upper()
    return out


def email(w: _Words) -> str:
    first, last = w.pick(_GIVEN), w.syllables()
    local = w.pick([f"{first}.{last}", f"{last}.{first}", f"{first[0]}{last}", f"{last}_{first}", f"{first}-{last}", f"{first}{w.digits(2)}", f"bids+{last}", f"{last}.{first}.ctr", f"{first}{w.digits(1)}", "info", f"{first}_{last}{w.digits(2)}"])
    host = ".".join(([w.pick(["mail", "hq", "proc", "bids"])] if w.r.random() < 0.35 else []) + [w.syllables(), *w.pick([["example"], ["example", "org"], ["test"], ["invalid"], ["co", "example"], ["gov", "example"], ["com"], ["gov"]])])
    form = w.r.random()
    if form < 0.55:
        out = f"{local}@{host}"
    else:
        at = w.pick([" (at) ", " [at] ", " AT ", " at ", "(at)", "[at]"])
        if at == " at " or w.r.random() < 0.5:
            dot = w.pick([" (dot) ", " [dot] ", " DOT " if "AT" in at else " dot "])
            host = host.replace(".", dot)
        out = local + at + host
    return out.upper() if w.r.random() < 0.07 and "(" not in out else out


def phone(w: _Words) -> str:
    a, b, c = w.pick(["212", "303", "415", "512", "617", "701", "808", "907"]), "555", "01" + w.digits(2)
    form = w.pick([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"{a}/{b}-{c}", f"+1 {a} {b} {c}", f"+1({a}){b}.{c}", f"1-{a}-{b}-{c}", f"{b}-{c}",
                   f"+44 20 7946 0{w.digits(3)}", f"+49 30 {w.digits(6)}", f"+33 1 {w.digits(2)} {w.digits(2)} {w.digits(2)} {w.digits(2)}", f"+1-{a}-{b}-{c}", f"001 {a} {b} {c}", f"({a}) {b} {c}"])
    if w.r.random() < 0.25 and not form.startswith("+4"):
        form += w.pick([f" x{w.digits(2)}", f" ext. {w.digits(3)}", f" ext {w.digits(3)}", f" x{w.digits(3)}", f", ext. {w.digits(2)}"])
    return form


def id_number(w: _Words) -> tuple[str, str]:
    """The words before the number, which stay, and the number."""
    ssn = w.pick([f"{w.digits(3)}-{w.digits(2)}-{w.digits(4)}", f"{w.digits(3)} {w.digits(2)} {w.digits(4)}", w.digits(9)])
    return w.pick([
        ("SSN ", ssn), ("SS# ", ssn), ("social security number ", ssn), ("social security no. ", ssn), ("taxpayer ID ", ssn), ("tax ID ", ssn), ("TIN ", ssn), ("SSN: ", ssn),
        ("passport no. ", f"{w.letter()}{w.digits(7)}{w.letter() if w.r.random() < 0.6 else ''}"), ("passport number ", f"{w.letter()}{w.digits(7)}"), ("passport ", f"{w.letter()}{w.digits(8)}"),
        ("badge number ", f"{w.letter()}{w.digits(6)}"), ("badge no. ", f"{w.digits(5)}"), ("badge ", f"{w.letter()}-{w.digits(5)}"), ("employee ID ", f"{w.digits(2)}-{w.digits(4)}-{w.letter()}"), ("employee number ", w.digits(6)),
        ("identity card ", f"{w.digits(8)}{w.letter()}"), ("ID card ", f"{w.digits(8)}{w.letter()}"), ("driver license ", f"{w.letter()}{w.digits(3)}-{w.digits(4)}-{w.digits(4)}"), ("driver's license no. ", f"{w.letter()}{w.digits(7)}"),
        ("national insurance number ", f"QQ {w.digits(2)} {w.digits(2)} {w.digits(2)} {w.pick('ABCD')}"), ("NI number ", f"QQ{w.digits(6)}{w.pick('ABCD')}"), ("residence permit ", f"{w.letter()}{w.digits(8)}"),
    ])


def address(w: _Words) -> str:
    street, town = w.proper(), w.proper()
    code, post = w.pick(["QX", "ZV", "XK", "NY", "TX", "OH"]), "00" + w.digits(3)
    form = w.r.random()
    if form < 0.2:
        return f"{street}{w.pick(['weg', 'straße', 'strasse', 'gasse', 'allee', 'platz'])} {w.r.randint(1, 130)}" + (f", {post} {town}" if w.r.random() < 0.8 else "")
    if form < 0.36:
        return f"{w.r.randint(1, 220)} {w.pick(['rue', 'avenue', 'boulevard', 'rue de', 'calle', 'via'])} {street}" + (f", {post} {town}" if w.r.random() < 0.8 else "")
    lead = w.pick(["", "", "", "N. ", "S.E. ", "West ", "S. ", "East ", "NW "])
    kind = w.pick(["Street", "Road", "Lane", "Avenue", "Boulevard", "Way", "Court", "Parkway", "Drive", "Place", "St.", "Ave.", "Blvd", "Rd", "Rd.", "Ave", "Blvd.", "St"])
    out = f"{w.r.randint(10, 9999)} {lead}{street} {kind}"
    if w.r.random() < 0.55:
        out += w.pick([f", Apt. {w.r.randint(1, 60)}{w.pick(['', 'A', 'B', 'C'])}", f", Suite {w.r.randint(100, 990)}", f", Floor {w.r.randint(1, 20)}", f" #{w.r.randint(1, 90)}", f", Unit {w.r.randint(1, 40)}"])
    if w.r.random() < 0.6:
        out += f", {town}, {code} {post}" if w.r.random() < 0.85 else f", {town}"
    return out.upper() if w.r.random() < 0.06 else out


def _prose(w: _Words) -> str:
    """A sentence without details."""
    p, n, a, v, r = w.proper, lambda: w.pick(_NOUNS), lambda: w.pick(_ADJ), lambda: w.pick(_VERBS), lambda: w.pick(_ROLES)
    date = w.pick([f"{w.r.randint(1, 28)} {w.pick(['March', 'JUN', 'October'])} 202{w.r.randint(3, 7)}", f"202{w.r.randint(3, 7)}-0{w.r.randint(1, 9)}-1{w.r.randint(0, 9)}", f"{w.r.randint(1, 12)}/{w.r.randint(1, 28)}/202{w.r.randint(3, 7)}", f"Sep {w.r.randint(1, 28)}, 2026"])
    time = w.pick([f"{w.r.randint(1, 12)}:30 PM", f"1{w.r.randint(0, 9)}:00", f"1{w.r.randint(0, 9)}30 hrs", f"{w.r.randint(1, 12)}:15am"])
    return w.pick([
        f"The contractor shall {v()} the {a()} {n()} and {v()} the {p()} {n()} every {w.r.randint(5, 90)} days at {p()}",
        f"Offers for the {p()} {n()} must reach the {p()} mail center no later than {date} at {time}",
        f"Carry ${w.r.randint(1, 9)},{w.pick(['250', '500', '000'])},000 in {a()} {n()} coverage for the {p()} {n()} and name {p()} as additional insured",
        f"{w.pick(_ADJ).capitalize()} {n()} experience earns up to {w.r.randint(5, 60)}% for {p()}",
        f"Use the {p()} bid room for the {p()} {n()}", f"Attach {w.r.randint(2, 90)} {a()} copies of the staffing matrix together with the {p()} {n()}",
        f"Industry code {w.r.randint(590000, 599999)} applies to the {p()} {n()}", f"including the {a()} {n()}, the {n()} and any {a()} {n()}",
        f"as set out in Section {w.letter()}.{w.r.randint(1, 20)} and the {p()} {n()} annex", f"unless the {r()} waives the {a()} {n()} in writing",
        f"so that the {r()} can {v()} the {a()} {n()}", f"in support of the {p()} {n()} and its {a()} {n()}", f"before the {a()} {n()} phase at {p()} begins", f"subject to the {p()} {n()} terms for {a()} {n()}",
        f"with the {n()} and {a()} {n()} priced apart for {p()}", f"The {r()} accepts written questions on {p()} {n()} until {time} on {date}", f"An intent notice naming the {p()} {n()} has to be lodged before {date}",
        f"{p()} {n()} weight: {w.r.randint(5, 60)} points", f"Line 00{w.digits(2)} {p()} {n()}, {a()} {n()}, qty {w.r.randint(2, 90)}", f"Attachment {w.letter()}-{w.r.randint(1, 20)}: {p()} {a()} {n()}",
        f"{p()} selects the lowest evaluated price whose {a()} {n()} and {p()} {n()} are acceptable", f"A {p()} account with {a()} {n()} rights is opened at the {p()} vendor portal",
        f"the {r()} turns away {a()} copies of the {p()} {n()}", f"Give the {r()} proof of ${w.r.randint(1, 9)},000,000 cover for {p()}", f"Under task {w.r.randint(1, 40)} of {p()}, {v()} the {a()} {n()}",
        f"A site visit to the {p()} {n()} takes place on {date} starting {time}, led by the {r()}", f"No bidder that wrote the {p()} {n()} or advised {p()} on the {a()} {n()} may compete",
        f"{p()} quotations close {date} at {time}, {p()} electronic dropbox clock", f"State how you {v()} {a()} {n()} for {p()}", f"Crews {v()} {a()} {n()}, {v()} the {n()} and report the {p()} {n()} to the {r()}",
        f"Keep the {p()} {n()} registration active for {p()}", f"The {p()} award weighs the {a()} {n()} above price and rests on best value to {p()}", f"Best value decides {p()}, {a()} {n()} first",
        f"Upload the {p()} {n()} and the {a()} {n()} to the upload portal run by {p()}, one archive per {n()}", f"Volume {w.r.randint(1, 9)} - {p()} {a().capitalize()} {n().capitalize()} ({w.pick(_FORMS).title()})", f"Attach the {w.pick(_FORMS)} with the {p()} {n()}",
        f"Certify in the {w.pick(_FORMS)} that the {p()} {n()} meets the {a()} {n()} standard of {p()}", f"Each volume holds the {w.pick(_FORMS)}, a {a()} {n()}, and the {a()} {n()} signed for {p()}", f"Include the {w.pick(_FORMS)} and {a()} {n()} in every {p()} volume",
        f"Describe how the {a()} {n()} links to the {p()} {n()} and who will {v()} the {n()} at {p()}", f"At least {w.r.randint(5, 60)} percent of the {p()} {n()} value flows to {p()} businesses doing {a()} {n()}", f"The {a()} volume on {p()} {n()} may run to {w.r.randint(5, 90)} pages, not counting the {w.pick(_FORMS)}",
        f"Plan {w.r.randint(5, 60)} points of {p()} {n()} work for {a()} firms", f"{p()} {n()} {w.pick(['due', 'deadline', 'closing'])}: {date}, {time}", f"Samples of the {a()} {n()} arrive at {p()} within {w.r.randint(5, 90)} days of the {p()} {n()} kickoff",
        f"Within {w.r.randint(5, 90)} days the vendor will {v()} all {a()} {n()} held in {p()} and hand the {p()} {n()} to the {r()}", f"The {p()} {r()} released {p()} {n()} without any set-aside despite the {a()} {n()} study", f"{p()} {n()} is reserved for small firms with a {p()} {n()} presence",
        f"All work on {p()} {n()} is done near {p()}, and {p()} pays for the {n()}", f"Deliver proposals for {p()} {n()} to the {p()} tender box by {date}", f"Please note: {v()} the {n()} for {p()}", f"Reminder: send the {p()} {n()} to {p()} before {date}", f"Show {w.r.randint(3, 60)} years of {a()} {n()} practice, one at {p()}",
    ])


def _lookalike(w: _Words) -> str:
    """What might be taken for a detail and is none."""
    p, n = w.proper, lambda: w.pick(_NOUNS)
    return w.pick([
        f"see the {p()} {p()} Foundation {n()}", f"see the {p()} County {n()} board", f"see the {p()} Street signs", f"see the room at {p()} Hall, floor {w.r.randint(1, 9)}", f"see {w.r.randint(10, 90)} avenue trees",
        f"see handle @{w.syllables()} feed", f"see stock number {w.digits(4)}-01-{w.digits(3)}-{w.digits(4)}", f"see drawing {w.digits(3)}-{w.digits(3)}", f"see contract {w.letter()}{w.digits(4)}-24-R-{w.digits(4)}",
        f"see entity ID {w.syllables()[:5].upper()}{w.digits(7)}", f"see rate of {w.r.randint(10, 90)} @ ${w.r.randint(10, 90)}.50", f"see {p()} {p()} LLC", f"see invoice {w.digits(3)}-{w.digits(2)}-{w.digits(2)}", f"see section {w.digits(3)}", f"see section {w.digits(3)}.{w.digits(3)}.{w.digits(4)}", f"under clause {w.digits(3)}.{w.digits(3)}-{w.digits(2)}", f"see invoice {w.digits(3)}-{w.digits(2)}-{w.digits(4)}", f"invoice no. {w.digits(8)}", f"see item {w.digits(3)}.{w.digits(2)}.{w.digits(4)}",
        f"under solicitation {w.letter()}{w.digits(5)}-2{w.digits(1)}-{w.digits(4)}", f"the {p()} {p()} Company", f"the {p()} Bridge at {p()}", f"on {p()} Road near {p()}", f"part number {w.digits(3)}-{w.digits(4)}", f"the {p()} and {p()} Group",
        f"between {p()} Avenue and {p()} Street", f"{p()} {p()} Inc.", f"the {p()} University {n()}", f"room {w.digits(3)} of the {p()} Building", f"account {w.digits(3)}-{w.digits(6)} of the agency", f"version {w.r.randint(1, 9)}.{w.r.randint(0, 9)}.{w.r.randint(0, 9)}",
        f"lot {w.digits(4)}-{w.digits(4)}", f"purchase order {w.digits(10)}", f"a budget of ${w.digits(3)},{w.digits(3)}", f"at a rate of {w.r.randint(2, 90)} @ {w.r.randint(2, 90)}", f"file number {w.digits(7)}", f"UEI {w.syllables()[:6].upper()}{w.digits(6)}",
        f"serial number {w.letter()}{w.letter()}{w.digits(8)}", f"the {p()} Tower on {p()} Square", f"ask for the {n()}", f"contact the {w.pick(_ROLES)}", f"write to the {w.pick(_ROLES)} before {w.r.randint(1, 28)} JUN 2026", f"call for {n()} offers", f"the {n()} signs for {p()}", f"the {p()} {n()} badge",
        f"THE {p().upper()} {n().upper()} AT {p().upper()} BEGINS", f"FOR {p().upper()}, CITING ONE {p().upper()} {n().upper()}", f"ISO {w.digits(4)}-{w.r.randint(1, 4)}", f"DUNS {w.digits(9)} of {p()} Ltd.",
    ])


def _detail(w: _Words) -> list[tuple[str, str]]:
    """Parts (text, label)."""
    kind = w.r.random()
    if kind < 0.36:
        who, role = name(w), w.pick(_ROLES)
        before, after = w.pick([
            ("contact ", ""), ("Contact ", ""), ("attn: ", ""), ("Attn: ", ""), ("ask for ", ""), ("Ask for ", ""), ("key person ", ""), ("Key person ", ""), ("POC ", ""), ("witnessed by ", ""), ("Witnessed by ", ""),
            ("badge issued to ", ""), ("Badge issued to ", ""), (f"the {role}, ", ""), (f"the {role}, ", ","), ("", " chairs the panel"), ("", f" signs for the {w.pick(_NOUNS)}"), ("as ", " told bidders"), ("As ", " told bidders"), ("signed by ", ""),
            ("reviewed by ", ""), ("Dear ", ","), ("", f", {role}"), ("", " will open the bids"), ("questions go to ", ""), ("report to ", ""), ("send it to ", ""), ("prepared by ", ""), ("", " approved the request"), (f"{role} ", ""), ("in care of ", ""),
            ("hand it to ", ""), ("POC: ", ""), ("Name: ", ""), ("cc ", ""), ("", " leads the team"), ("speak with ", ""), ("", f" accepts the {w.pick(_NOUNS)}"), ("interviews with ", ""), ("courier for ", ""),
        ])
        if after and not before:
            who = who[0].upper() + who[1:]
        return [(before, "O"), (who, "name"), (after, "O")]
    if kind < 0.52:
        mark = w.pick([("", "")] * 8 + [("<", ">")])
        lead = w.pick(["e-mail ", "E-mail ", "at ", "At ", "write to ", "Write to ", "mailto:", "Mailto:", "copy ", "Copy ", "email: ", "send to ", "mail ", "contact ", ""])
        return [(lead + mark[0], "O"), (email(w), "email"), (mark[1], "O")]
    if kind < 0.68:
        return [(w.pick(["tel. ", "Tel. ", "phone: ", "Phone: ", "call ", "Call ", "fax ", "Fax ", "mobile ", "Mobile ", "text ", "Text ", "or ", "Or ", "phone ", "cell ", "reach us at ", "telephone "]), "O"), (phone(w), "phone")]
    if kind < 0.84:
        words, number = id_number(w)
        lead = w.pick(["", "", "listed with ", "bearer of ", "cleared under ", "holder of ", "with ", "Listed with ", "Bearer of ", "Cleared under "])
        words = words if lead else w.pick([words, words[0].upper() + words[1:]])
        return [(lead + words, "O"), (number, "id_number")]
    return [(w.pick(["c/o ", "C/o ", "at ", "At ", "located at ", "Located at ", "residing at ", "Residing at ", "deliver to ", "Deliver to ", "mail to ", "Mail to ", "lives at ", "ship to ", "address: "]), "O"), (address(w), "address")]


def _more(w: _Words) -> Iterator[tuple[str, str]]:
    """Details one after another, as they are listed for one person."""
    yield from _detail(w)
    while w.r.random() < 0.45:
        yield (w.pick([", ", ", ", " - ", "; ", "; ", ". "]), "O")
        yield from _detail(w)


def _shout(w: _Words, text: str) -> str:
    words = text.split(" ")
    at = w.r.randrange(len(words))
    end = at + w.r.randint(2, 9)
    return " ".join(x.upper() if at <= i < end else x for i, x in enumerate(words))


def labelled(rows: int = 3600, seed: int = 11) -> list[list[tuple[str, str]]]:
    """The labelled table: ``rows`` texts as parts (text, label)."""
    w = _Words(seed)
    out = []
    for _ in range(rows):
        parts: list[tuple[str, str]] = []
        x = w.r.random()
        if x < 0.75:
            parts.append((_prose(w) + w.pick([", ", ". ", "; ", " (", ". "]), "O"))
        if x < 0.6 or x > 0.9:
            opened = parts and parts[-1][0].endswith("(")
            parts += _more(w)
            parts.append((")" if opened else "", "O"))
        elif x < 0.84:
            parts.append((w.pick(["", ", "]) + _lookalike(w), "O"))
        if w.r.random() < 0.45:
            parts.append((w.pick([". ", "; ", " "]) + _prose(w), "O"))
        parts.append((w.pick([".", ".", ".", "", ";"]), "O"))
        if w.r.random() < 0.08:  # a stretch in capitals
            parts = [(_shout(w, t) if label == "O" else t, label) for t, label in parts]
        out.append([(t, label) for t, label in parts if t])
    return out
