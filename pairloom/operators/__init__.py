"""Operators on panels, returns, pairs and trades."""
