"""All registered queries."""

from __future__ import annotations

from . import joining, ordering, projecting, reading  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
