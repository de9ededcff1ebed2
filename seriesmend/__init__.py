"""seriesmend: data quality for multivariate time series, and corpus preparation, on Spark."""

__version__ = "0.1.0"
