"""Training-data operators: deduplication, joins, scoring, mixing, packing.

Nothing outside this subpackage imports it.  Each ``opN_*`` module holds one
operator with a general interface; :mod:`spindrift.llm.registry` lists the thin
queries built on them.
"""
