"""tidemark: Spark-first analytics for slow oscillations in cohort-scale time series."""
