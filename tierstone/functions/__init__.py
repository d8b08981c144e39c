"""Membership filters and page arithmetic as columns."""
