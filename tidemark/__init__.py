"""tidemark: quote-tick research analytics on PySpark DataFrames."""
