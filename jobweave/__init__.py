"""A PySpark-native analytics engine for job-posting corpora and training-data pipelines."""
