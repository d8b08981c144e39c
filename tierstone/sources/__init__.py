"""Immutable runs and the manifest that names them."""
