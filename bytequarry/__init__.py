"""Chunk analytics on Spark: byte profiling, reversible transforms, routing and archives."""
