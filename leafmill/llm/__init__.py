"""Training-data operators: deduplication, decontamination, filters, mixing, formatting.

Nothing outside this subpackage imports it; deleting it (with ``tests/llm`` and
``corpus_pipeline.py``) leaves the rest of the library whole.
"""
