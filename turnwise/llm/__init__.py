"""Training-data pipeline operators: packing, decontamination, chat, WARC,
quality, toxicity, token files, LM scoring, license scans, similarity join.

Nothing outside this subpackage imports it.
"""
