"""Scans and connectors."""
