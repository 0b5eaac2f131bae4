"""City geodata on Spark."""
