"""Point-pattern localisation and recognition, and evaluation of it, on Spark."""
