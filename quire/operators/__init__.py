"""operators of the document graph."""
