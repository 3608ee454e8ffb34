"""Analytics of daily price observations from many markets, as Spark DataFrame functions."""
