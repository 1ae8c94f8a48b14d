"""Analytics over multiple-choice model evaluations, on Spark DataFrames."""
