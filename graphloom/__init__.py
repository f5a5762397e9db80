"""Community search and community analytics on large graphs as Spark DataFrames, and operators for text corpora in ``llm``."""
