"""Column functions built from ``pyspark.sql.functions`` only."""
