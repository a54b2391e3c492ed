"""Reading and writing of translation-memory files."""
