"""Training-data operators over a table of documents; nothing outside this subpackage imports it."""
