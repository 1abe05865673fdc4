"""Reading uploads and storing datasets."""
