"""Hustings: roll-call and manifesto analytics as Spark jobs."""
