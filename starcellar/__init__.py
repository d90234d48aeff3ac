"""starcellar: retail and wholesale warehouse analytics as Spark DataFrame jobs."""
