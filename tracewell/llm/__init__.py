"""Training-data operators: near duplicates, decontamination, packing, language, quality, files.

Nothing outside this folder, `corpus_pipeline.py` and `tests/llm` imports it.
"""
