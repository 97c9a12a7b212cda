"""Training-data operators: mixing, deduplication, scoring, extraction, sharding.

Every operator takes and returns DataFrames; ``queries`` holds the thin
``opN_<name>`` queries.  Nothing outside this subpackage imports it.
"""
