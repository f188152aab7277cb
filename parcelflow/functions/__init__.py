"""Column expressions: text, dates, geography, postcodes, statuses."""
