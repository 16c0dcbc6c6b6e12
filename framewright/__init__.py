"""framewright: ordered frame-sequence analytics on Spark DataFrames."""
