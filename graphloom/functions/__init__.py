"""The functions of graphloom."""
