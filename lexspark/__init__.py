"""lexspark: corpus, vocabulary-deck and learner analytics expressed as Spark plans."""
