"""Operators on wide tables, panels and cohorts."""
