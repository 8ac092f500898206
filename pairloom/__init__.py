"""pairloom: preference-data analytics expressed as Spark DataFrame plans."""
