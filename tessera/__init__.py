"""Hybrid retrieval, relevance analytics and corpus preparation as Spark jobs."""
