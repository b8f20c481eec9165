"""Content-addressed archive analytics on PySpark."""
