"""Training-data operators: filtering, deduplication, mixing, packing and search at corpus scale.

Nothing outside this subpackage imports it; ``millrace.llm.entry`` lists its queries.
"""
