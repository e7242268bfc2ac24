"""The same candles, signals and indicators on Structured Streaming."""
