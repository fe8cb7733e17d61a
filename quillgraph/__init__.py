"""quillgraph: graph retrieval and text analytics on Spark DataFrames."""
