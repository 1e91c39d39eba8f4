"""Search, retrieval and analytics on PySpark DataFrames."""
