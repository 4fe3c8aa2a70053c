"""Reading, landing and listing tables."""
