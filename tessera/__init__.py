"""A knowledge-base retrieval and analytics engine on Spark DataFrames."""
