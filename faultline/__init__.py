"""faultline: app-stability analytics as PySpark DataFrame jobs."""
