"""Spelling correction, fuzzy string search and training-data operations over DataFrames."""
