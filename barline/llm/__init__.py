"""Training-data operators: text, vector, archive and token work on Spark."""
