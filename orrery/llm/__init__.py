"""Training-data operators: deduplication, mixing, packing, quality, chat, language models, search.

Nothing outside this subpackage imports it; ``registry`` binds the operators to the driver's tables.
"""
