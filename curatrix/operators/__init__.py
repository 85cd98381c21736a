"""Operators on edge tables, names, documents, responses, reviews and anomaly logs."""
