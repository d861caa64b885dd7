"""KPI analytics on Spark: quality, baselines, impact statistics, anomaly detection and trends over every series at once."""
