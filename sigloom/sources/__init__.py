"""Readers that turn catalogue vocabularies, archives and results files into DataFrames."""
