"""Drift and collapse analytics for generated text, as Spark plans."""
