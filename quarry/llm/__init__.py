"""Training-data operators: quality, tokens, duplicates, leaks, extraction, sharding.

Each module holds one operator with a general interface on DataFrames;
``queries.py`` derives the registered ``opN_*`` results from them.  Nothing
outside this folder imports it.
"""
