"""Comment events as streams."""
