"""The sources of graphloom."""
