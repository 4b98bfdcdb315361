"""DataFrame operators: each takes a table (or stream) and returns one."""
