"""Reading documents, and versioned storage."""
