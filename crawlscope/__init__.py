"""Web-corpus domain analytics on PySpark."""
