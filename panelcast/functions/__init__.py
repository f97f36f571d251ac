"""Column-level helpers: role detection, date parsing, formatting, text."""
