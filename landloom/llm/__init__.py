"""Training-data operators on text, page and vector tables.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; ``queries.py`` binds them to the test tables.
"""
