"""edupulse: learning analytics over whole populations, as PySpark DataFrame operators."""
