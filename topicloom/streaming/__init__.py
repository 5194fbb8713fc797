"""Streaming use of the operators."""
