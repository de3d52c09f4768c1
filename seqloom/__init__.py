"""Labelled time sequences on Spark: DataFrame in, DataFrame out."""
