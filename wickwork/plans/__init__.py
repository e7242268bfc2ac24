"""Whole plans: candle views of the given tables, the chain-wide signal run, and the registered queries."""
