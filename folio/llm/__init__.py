"""Operators of a training-data pipeline; nothing else in folio imports this subpackage."""
