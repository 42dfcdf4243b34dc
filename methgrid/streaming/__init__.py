"""Running totals over files that keep arriving."""
