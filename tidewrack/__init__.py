"""Forensic timelines from binary artifacts, on Spark."""
