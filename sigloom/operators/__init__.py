"""Operators over DataFrames: each module holds one problem's operator."""
