"""Frames as they arrive."""
