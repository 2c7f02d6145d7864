"""Query registry (what ``__spark_entry__`` exposes), oracle SQL and end-to-end jobs."""
