"""Streams of samples into maps."""
