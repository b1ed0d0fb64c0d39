"""Speech-corpus and text analytics on Spark DataFrames."""
