"""Training-data operators: scans, joins, indexes and models over documents, pages and embeddings."""
