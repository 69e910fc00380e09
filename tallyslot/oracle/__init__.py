"""Independent SQL statements that the Spark results are checked against."""
