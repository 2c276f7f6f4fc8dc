"""Relational operators: parsing, cascade, joins, evaluation, reports."""
