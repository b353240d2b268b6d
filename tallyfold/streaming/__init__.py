"""Tables that grow while they are read."""

from tallyfold.streaming.csv_folder import read_csv_stream

__all__ = ["read_csv_stream"]
