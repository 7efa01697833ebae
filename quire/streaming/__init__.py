"""streaming of the document graph."""
