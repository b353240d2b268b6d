"""Tables from folders, and results into files."""
