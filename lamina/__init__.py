"""lamina: layered retrieval analytics expressed as Spark jobs."""
