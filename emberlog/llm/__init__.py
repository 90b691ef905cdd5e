"""Operators of a training-data pipeline: rules, filters, duplicates, secrets, packing, archives."""
