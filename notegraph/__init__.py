"""A PySpark engine for linked note collections: parsing, link graphs, vectors, quality rules, metrics and views."""
