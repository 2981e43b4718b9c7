"""Writers: packages, report tables, canonical JSON."""
