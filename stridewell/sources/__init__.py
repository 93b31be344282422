"""Readers of sessions, samples and exported activities."""
