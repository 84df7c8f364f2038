"""Binary-delta analytics on PySpark."""
