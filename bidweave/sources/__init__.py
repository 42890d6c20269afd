"""Sources: tables, page texts, manifests, uploads."""
