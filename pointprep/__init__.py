"""Point-cloud preparation, sampling and evaluation as Spark DataFrame operators."""
