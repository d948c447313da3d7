"""Panel analytics on Spark: time-series, cross-section and evaluation operators as DataFrame plans."""
