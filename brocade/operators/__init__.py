"""Operators over DataFrames of cases, records and mask pixels."""
