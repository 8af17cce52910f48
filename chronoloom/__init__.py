"""chronoloom: Spark-first operators for multivariate time series and training-data preparation."""
