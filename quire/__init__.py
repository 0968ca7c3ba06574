"""quire: ordered-document processing on Spark DataFrames."""
