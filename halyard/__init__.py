"""halyard: embedding retrieval and corpus preparation as Spark plans."""
