"""A PySpark engine for publishing document corpora incrementally."""
