"""Spark-first analytics over optical-disc images: layouts, chunks, digests, catalogues."""
