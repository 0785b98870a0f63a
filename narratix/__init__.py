"""narratix: documents to narration-ready text, chunks and reports on Spark DataFrames."""
