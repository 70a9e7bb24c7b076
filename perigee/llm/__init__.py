"""Operators of a training-data pipeline: fingerprints, filters, joins, packing and sharding of documents."""
