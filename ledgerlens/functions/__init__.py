"""Column-level helpers: local time, rate cards, money arithmetic."""
