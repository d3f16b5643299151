"""Point-in-time entity analytics as lazy Spark DataFrame operators."""
