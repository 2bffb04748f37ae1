"""Composite plans: data-derived cleaning plans and profile reports."""
