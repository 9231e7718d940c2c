"""Registered queries of the training-data operators."""

from __future__ import annotations

from . import bpe, chat, collocations, divergence, fingerprints, langid, licenses, mixing, neardup, sharding, topk, urls, warc  # noqa: F401
from .common import ORACLE, QUERIES  # noqa: F401
