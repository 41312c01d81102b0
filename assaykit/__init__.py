"""Evaluation analytics and dataset curation as Spark jobs."""
