"""Column expressions: dates, geography, colours, text and missing values."""
