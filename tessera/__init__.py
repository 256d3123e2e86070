"""Text retrieval, citation checking and corpus preparation as Spark plans."""
