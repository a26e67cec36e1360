"""Listing, activity-evidence and corpus analytics as Spark jobs."""
