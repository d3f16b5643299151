"""Adapters that give the test tables the shape of linked administrative records, and the query catalog."""
