"""Column expressions: text, numbers, patterns, dates, rules."""
