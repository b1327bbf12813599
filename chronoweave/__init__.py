"""Interval, event-track, transcript and document-diff analytics on Spark."""
