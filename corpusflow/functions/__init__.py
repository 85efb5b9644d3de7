"""Column functions: text, URLs, dates and keys. All are Catalyst expressions."""
