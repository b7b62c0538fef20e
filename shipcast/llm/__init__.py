"""Operators of a training-data pipeline: language ID, decontamination,
toxicity, nearest neighbours, repeats, line dedup, personal data, near
duplicates, packing and chat formatting.  Nothing else in the library imports
this package."""
