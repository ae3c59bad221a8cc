"""Live bars."""
