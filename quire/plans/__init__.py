"""plans of the document graph."""
