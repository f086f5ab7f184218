"""heddle: evidence-first analytics over documents, links and events, as Spark plans."""
