"""Provenance and evidence analytics expressed as Spark DataFrame programs."""
