"""Reading landed files and writing tables."""
