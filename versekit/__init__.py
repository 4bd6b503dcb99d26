"""versekit: Spark-native analytics for text corpora grouped into tracks, artists and genres.

Subpackages: ``functions`` (Column expressions), ``sources`` (tables, files,
payloads), ``operators`` (statistics, filters, phrases, vectors, models,
topics, ordinals), ``plans`` (shared corpus tables, query catalog, SQL
oracles) and ``streaming`` (incremental updates).
"""

__version__ = "0.1.0"
