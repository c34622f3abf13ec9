"""Training-data operators on Spark.  Nothing else in the package imports this subpackage."""
