"""plantspark: plant sensor time-series analytics written as Spark plans."""
