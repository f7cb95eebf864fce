"""vellum: document analytics on Spark DataFrames."""
