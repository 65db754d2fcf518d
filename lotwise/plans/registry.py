"""Registered queries and their SQL twins."""

from __future__ import annotations

from lotwise.plans import fields as _fields  # registers its queries too
from lotwise.plans import grammars as _grammars
from lotwise.plans import houses as _houses
from lotwise.plans import market
from lotwise.plans import more as _more
from lotwise.plans import stores as _stores
from lotwise.plans import texts as _texts

QUERIES: dict = market.QUERIES
ORACLES: dict[str, str] = market.ORACLES
__all__ = ["ORACLES", "QUERIES", "_fields", "_grammars", "_houses", "_more", "_stores", "_texts"]
