"""Cleaning, validating and querying bibliographic records with Spark."""
