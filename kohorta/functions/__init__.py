"""Column-level helpers: null rules, dates, text, bins, p-value tails."""
