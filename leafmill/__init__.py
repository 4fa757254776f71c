"""Spark-native document processing: extraction, emission, validation, audit, job events."""
