"""Operators: cleansing, quality, change application, history, joins, reconciliation."""
