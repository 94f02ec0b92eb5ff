"""Scalar matching of text and of result sets."""
