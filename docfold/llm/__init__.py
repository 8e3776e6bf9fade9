"""Training-data operators: filtering, deduplication, tokenisation, search, packing and LM scoring.

Nothing outside this folder imports it.  Every module is one operator with a general
``DataFrame -> DataFrame`` interface; ``queries`` holds the registered ``opN_*`` queries.
"""
