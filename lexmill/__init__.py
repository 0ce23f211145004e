"""lexmill: text classification analytics on PySpark."""
