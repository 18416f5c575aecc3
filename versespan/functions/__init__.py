"""Column-to-Column building blocks; nothing here runs a job or a Python UDF."""
