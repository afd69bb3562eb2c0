"""Operations of a large-scale training-data pipeline on DataFrames of documents and vectors.

Nothing else in the library imports this subpackage. Each operator has its own module with a
general interface; ``queries.py`` holds the thin queries that apply them to the whole tables.
"""
