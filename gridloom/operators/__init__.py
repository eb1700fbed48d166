"""Relational operators over coordinate frames."""
