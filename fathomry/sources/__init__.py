"""Sources: source trees, tables, artifacts, and the extractors that turn files into rows."""
