"""opslens: operations analytics as lazy PySpark DataFrame jobs."""
