"""Document analytics on Spark: DataFrame-to-DataFrame operators over text relations."""
