"""Scalar building blocks as Catalyst expressions."""
