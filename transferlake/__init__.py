"""Course-transfer analytics as Spark DataFrame jobs."""
