"""Documents as streams."""
