"""Reading and writing: tables, pages, reports, and the adapter from the given tables."""
