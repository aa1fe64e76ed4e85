"""quillstone: document-text analytics expressed as Spark DataFrames."""
