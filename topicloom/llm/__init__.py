"""Operators for preparing language-model training data, each by a named published method."""
