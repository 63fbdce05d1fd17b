"""Relational operators, generic in their key columns."""
