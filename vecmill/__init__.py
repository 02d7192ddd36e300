"""vecmill: dense retrieval, ranking evaluation and retrieval-policy analytics as Spark DataFrames."""
