"""quarry: retrieval, code navigation and corpus operators as Spark DataFrame plans."""
