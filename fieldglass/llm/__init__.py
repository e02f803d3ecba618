"""Operators for training corpora: language, licences, urls, copies, mixing, shards, secrets, packing."""
