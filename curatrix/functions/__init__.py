"""Column functions: names, directions, ids, packed edges, documents and responses."""
