"""Training-data operators: scoring, de-duplication, tokenising, mixing and sharding.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries.
"""
