"""Training-data operators: mixing, language, toxicity, decontamination, sharding, line and near dedup, token output, quality.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
