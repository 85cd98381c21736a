"""Readers and writers of edge tables, dictionaries, documents, responses and review files."""
