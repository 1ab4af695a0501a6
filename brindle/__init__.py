"""Evidence retrieval and analytics over text and code corpora, on PySpark."""
