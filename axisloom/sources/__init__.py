"""Stores and their codecs."""
