"""functions of the document graph."""
