"""Streaming of the contact-map engine."""
