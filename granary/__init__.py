"""granary: document-retrieval and training-data processing as Spark jobs."""
