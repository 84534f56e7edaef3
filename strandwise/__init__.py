"""strandwise: molecular-sequence analytics over Spark DataFrames."""
