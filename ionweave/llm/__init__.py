"""Training-data operators: one module per operator, each with its query.

``registry.QUERIES`` and ``registry.ORACLE_SQL`` collect the ``opN_*`` entries.
Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
