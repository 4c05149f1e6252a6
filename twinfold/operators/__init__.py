"""Operators on listings: filters, screening, verification, source selection, plans, cache, statistics."""
