"""tessera: document and knowledge-graph analytics on Spark DataFrames."""
