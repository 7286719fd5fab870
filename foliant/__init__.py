"""Foliant: page-evidence retrieval and trajectory analytics as Spark jobs."""
