"""Fleet-activity analytics on PySpark."""
