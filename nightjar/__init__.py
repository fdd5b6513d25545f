"""nightjar: threat hunting over logs at rest, and corpus preparation, as PySpark jobs."""
