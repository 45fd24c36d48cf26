"""Operators over DataFrames of the document-verification engine."""
