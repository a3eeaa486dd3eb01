"""Evidence analytics on Spark: DataFrame operators for document, fact, retrieval, evaluation and stream work."""
