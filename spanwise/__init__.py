"""spanwise: a Spark-first engine for spatial-interaction and observation data."""
