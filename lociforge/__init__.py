"""Table operators for regulatory genomics on Spark: every one takes and returns DataFrames."""
