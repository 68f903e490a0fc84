"""Monitoring of entities, documents and event streams as PySpark functions."""
