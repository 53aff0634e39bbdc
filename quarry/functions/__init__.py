"""Types, spatial expressions, text."""
