"""Analytics over conversational-agent corpora, expressed as Spark DataFrame plans."""
