"""Book-of-business reconciliation and data preparation on Spark DataFrames."""
