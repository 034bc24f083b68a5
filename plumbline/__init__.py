"""Detection evaluation and dataset audit on Spark."""
