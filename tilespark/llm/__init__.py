"""Training-data operators: each module holds one operator, ``queries`` holds the registered queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
