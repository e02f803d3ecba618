"""PySpark operators for sports event data, in batch and in streaming."""
