"""Reading, keeping and writing tables."""
