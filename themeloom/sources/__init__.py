"""Reading and writing tables, and the checks on what was read."""
