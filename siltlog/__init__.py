"""Log-structured key/record analytics on PySpark."""
