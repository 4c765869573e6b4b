"""Version-applicability and entity-resolution analytics on Spark DataFrames."""
