"""Segment ranking, run analytics and corpus preparation as Spark DataFrame jobs."""
