"""Operators for preparing training data: documents in, documents or verdicts out."""
