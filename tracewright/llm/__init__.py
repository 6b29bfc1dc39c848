"""Operators for training-data pipelines over free text. Nothing outside this subpackage imports it."""
