"""Stream timelines and training-data preparation as Spark DataFrame programs."""
