"""Lens plans and the registered queries."""
