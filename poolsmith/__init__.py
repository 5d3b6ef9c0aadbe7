"""Poolsmith: a PySpark engine to build and evaluate text-retrieval benchmarks."""
