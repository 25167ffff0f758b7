"""Geospatial feature engine expressed as Spark DataFrame plans."""
