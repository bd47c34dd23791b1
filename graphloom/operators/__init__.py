"""The operators of graphloom."""
