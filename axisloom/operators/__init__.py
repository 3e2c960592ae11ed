"""Operators over measures, labels and axes."""
