"""runlens: run-history and job-catalogue analytics as Spark DataFrame jobs."""
