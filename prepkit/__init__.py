"""Table preparation, profiling, drift, modelling and forecasting on Spark DataFrames."""

__version__ = "0.1.0"
