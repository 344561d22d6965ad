"""The stateless functions on streams of files."""
