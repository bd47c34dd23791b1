"""The streaming of graphloom."""
