"""Registered queries over the given tables, each with the same query in plain SQL."""

from topicloom.catalog import clustering, corpora, keywords, large, searching, texts  # noqa: F401
from topicloom.catalog.registry import ORACLES, QUERIES  # noqa: F401
