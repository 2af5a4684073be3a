"""Functions of the contact-map engine."""
