"""Search-relevance analytics on Spark: judged hits, pooled metrics, statistics, catalogues, retrieval."""
