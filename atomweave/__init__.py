"""atomweave: molecular-structure analytics as Spark DataFrame, SQL and Structured Streaming plans."""
