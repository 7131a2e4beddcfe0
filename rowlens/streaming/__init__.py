"""Comparison of unbounded inputs (beyond parity)."""
