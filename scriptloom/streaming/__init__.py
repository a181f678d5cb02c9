"""The same jobs over arriving files."""
