"""Training-data operators: near-dedup, quality, licences, HTML, tokens, mixing, PII, chat, decontamination,
lexical search, streaming dedup, divergence of sources.

Nothing outside this subpackage imports it.
"""
