"""Notes as a stream of files."""
