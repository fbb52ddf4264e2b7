"""Reading, checking and writing tables."""
