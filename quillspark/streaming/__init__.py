"""Records from CSV drops as a stream."""

from .csv_stream import record_stream

__all__ = ["record_stream"]
