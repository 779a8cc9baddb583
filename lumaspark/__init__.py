"""Still-image container analytics and corpus preparation on Spark DataFrames."""
