"""Operators for building training corpora: language, URLs, search, fingerprints, shards, tokens, licences, near copies, packing, toxicity."""
