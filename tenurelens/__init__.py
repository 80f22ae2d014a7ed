"""Workforce-history analytics on Spark DataFrames.

Pay-period records become an employee-by-fiscal-year panel, then a training
frame, a one-year-ahead scoring frame, and the input and output of a
class-weighted random forest. Every step maps DataFrames to DataFrames.
"""

from tenurelens.config import PolicyConfig

__all__ = ["PolicyConfig"]
