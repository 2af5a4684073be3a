"""Sources of the contact-map engine."""
