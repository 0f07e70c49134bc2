"""Operators for preparing large text corpora. Nothing else in larkspur imports this subpackage."""
