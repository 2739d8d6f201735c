"""Relational operators over the stops relation."""
