"""Scalar functions: sizes, globs, paths, messages."""
