"""Relational and rule-driven operators (DataFrame -> DataFrame)."""
