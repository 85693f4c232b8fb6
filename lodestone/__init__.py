"""Retrieval and analytics on Spark: ranked inverted indexes, facets, vectors, fusion and tiered datasets."""
