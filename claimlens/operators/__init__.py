"""operators: DataFrame in, DataFrame out."""
