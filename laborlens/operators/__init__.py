"""Analytic operators over the market's tables."""
