"""Composed plans: approved-mapping configuration and the registered queries."""
