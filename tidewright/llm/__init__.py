"""Operators of a training-data pipeline: mixing, extraction, fingerprints, tokens, quality, search, joins, shards, licences, divergences, decontamination, manifests.

Nothing else in the library imports this subpackage.
"""
