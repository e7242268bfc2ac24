"""DataFrame to DataFrame operators on candles, signals, events, trades and pattern rows."""
