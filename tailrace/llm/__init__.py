"""Operators for training-data pipelines: distinct counts over huge sets, most
frequent items, packing, evaluation leaks and text quality.  Nothing outside
this package imports it."""
