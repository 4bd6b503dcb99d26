"""DataFrame -> DataFrame operators: statistics, filters, ordinals, phrases, vectors,
similarity, models, topics and evaluation."""
