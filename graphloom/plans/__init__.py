"""The plans of graphloom."""
