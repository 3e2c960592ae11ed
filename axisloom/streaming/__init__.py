"""Incremental maintenance of additive statistics."""
