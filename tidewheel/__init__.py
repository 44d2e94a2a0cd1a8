"""tidewheel: DataFrame-in, DataFrame-out operators for keyed series on Spark."""
