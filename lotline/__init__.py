"""Feature analytics and sequential model search on Spark DataFrames."""
