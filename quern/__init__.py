"""Document retrieval, curation and evaluation as Spark DataFrame plans."""
