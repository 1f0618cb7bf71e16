"""Text preparation, catalog and job-table analytics as PySpark DataFrame jobs."""
