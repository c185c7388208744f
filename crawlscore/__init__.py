"""Website-audit analytics over whole crawl corpora, as Spark DataFrame jobs."""
