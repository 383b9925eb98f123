"""tessera: lead, registry and job-search analytics as Spark DataFrame plans."""
