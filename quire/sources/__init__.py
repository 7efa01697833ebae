"""Files and folders that the document graph reads and writes."""
