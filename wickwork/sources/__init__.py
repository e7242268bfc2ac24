"""Readers and writers of candles, instruments, settlements, results and snapshots."""
