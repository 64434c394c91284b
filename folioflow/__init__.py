"""Spark-native document analytics: catalogs, ordered items, rich text, references and pagination as DataFrames."""
