"""Marts, extracts, dimensions and BI datasets (one module per family)."""
