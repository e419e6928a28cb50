"""tapeframe: per-episode analytics over event tapes, as PySpark DataFrame jobs."""
