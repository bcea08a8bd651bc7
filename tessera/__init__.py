"""Catalogue search, query understanding and their ETL as PySpark DataFrame operators."""
