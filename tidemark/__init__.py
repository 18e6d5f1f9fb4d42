"""Tidemark: a Spark-native engine for knowledge corpora (notes, code, graphs and retrieval)."""
