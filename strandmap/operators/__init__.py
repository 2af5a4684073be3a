"""Operators of the contact-map engine."""
