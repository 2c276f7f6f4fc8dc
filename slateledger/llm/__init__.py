"""Training-data pipeline operators over a documents table (doc_id, text, ...)."""
