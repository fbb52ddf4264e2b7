"""Subscriber retention analytics as Spark DataFrame jobs."""
