"""Readers: table folders and document files, as batch or stream."""
