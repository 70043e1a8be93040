"""Reading the domain file formats, and writing and caching tables."""
