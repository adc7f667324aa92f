"""Imports every query module of this subpackage and hands out what they registered."""

from __future__ import annotations

from . import (  # noqa: F401
    q_collocations,
    q_decontam,
    q_jaccard,
    q_langcrf,
    q_linededup,
    q_lzprint,
    q_mixing,
    q_packing,
    q_repair,
    q_suffixdedup,
    q_tagpath,
    q_turns,
    q_urlfilter,
)
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
