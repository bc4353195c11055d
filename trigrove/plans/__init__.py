"""Plans of whole requests."""
