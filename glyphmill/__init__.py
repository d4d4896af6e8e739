"""Document understanding and dataset curation on Spark tables."""
