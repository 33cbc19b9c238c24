"""Observation-fusion analytics, expressed as Spark DataFrame plans."""
