"""People-and-posts analytics on Spark: DataFrame-in, DataFrame-out operators."""
