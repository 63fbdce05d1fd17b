"""sparrowdex: a declaration index and its queries as Spark DataFrames."""
