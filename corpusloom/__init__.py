"""Speech and text corpus engineering on Spark DataFrames."""
