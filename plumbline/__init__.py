"""Retrieval-augmented classification and its evaluation on Spark DataFrames."""

from plumbline.session import configure

__all__ = ["configure"]
