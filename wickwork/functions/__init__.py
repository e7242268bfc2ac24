"""Column expressions: time, symbols, candle predicates, bands and the scalar functions of conditions."""
