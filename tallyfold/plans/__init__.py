"""The query catalogue, and a second engine to hold results against."""
