"""Point-in-time time-series and text analytics on Spark."""
