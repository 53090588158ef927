"""Rostrum: corpus curation, linguistic features and class statistics on Spark."""
