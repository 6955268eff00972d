"""Operators for preparing training data: filters, scans, joins and encoders over document tables.

Nothing else in the library imports this subpackage.  Every operator takes and returns
DataFrames; the contract queries and their SQL are in :mod:`ledgerlens.llm.queries`.
"""
