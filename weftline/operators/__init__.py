"""Operators over segments and units, as column expressions."""
