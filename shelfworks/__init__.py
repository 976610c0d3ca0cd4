"""Product-catalogue jobs on Spark: DataFrame in, DataFrame out."""
