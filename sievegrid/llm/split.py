"""Cutting oversized texts into overlapping pieces at the pauses of the text."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_columns

#: Pauses, strongest first; a cut goes behind the match.
PAUSES = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？][”’」』]*"),
    re.compile(r"[;:,]\s+|[，、；：]"),
    re.compile(r"\s+"),
)


def token_offsets(text: str, unit: str) -> np.ndarray:
    """Start of every token in characters, and the length of the text at the end.

    ``chars``: each character is a token. ``words``: a token is a run of non-blanks with the blanks
    behind it (blanks at the start belong to the first).
    """
    if unit == "chars":
        return np.arange(len(text) + 1)
    if unit == "words":
        starts = [m.start() for m in re.finditer(r"\S+", text)]
        return np.array([0, *starts[1:], len(text)] if starts else [0, len(text)])
    raise ValueError(f"unknown unit {unit!r}")


def spans(text: str, limit: int, overlap: int, unit: str = "chars") -> list[tuple[int, int]]:
    """Character spans of the pieces of ``text``, each of at most ``limit`` tokens.

    Consecutive pieces share exactly ``overlap`` tokens. A cut is the last pause of the strongest kind
    in the second half of the piece, else the last pause of any kind that still moves on, else a hard cut
    at the limit. A text within the limit is one piece; an empty text has none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    at = token_offsets(text, unit)
    n = len(at) - 1
    if not text or n <= limit:
        return [(0, len(text))] if text else []
    # pauses as sorted token indices; a pause inside a token moves back to the start of the token
    levels = [np.unique(np.searchsorted(at, [m.end() for m in p.finditer(text)], "right") - 1) for p in PAUSES]
    out, start = [], 0
    while start + limit < n:
        last = [int(a[i]) if (i := np.searchsorted(a, start + limit, "right") - 1) >= 0 else -1 for a in levels]
        half = start + max(overlap, limit // 2)
        cut = next((c for c in last if c > half), max(last))
        if cut <= start + overlap:
            cut = start + limit
        out.append((int(at[start]), int(at[cut])))
        start = cut - overlap
    out.append((int(at[start]), len(text)))
    return out


def split_oversized(df: DataFrame, text: str, limit: int, overlap: int, unit: str = "chars") -> DataFrame:
    """Pieces of the rows of ``df`` whose ``text`` exceeds ``limit``: ``record_table``, ``record_key``,
    ``piece_no`` (from 1), ``start_pos`` and ``end_pos`` in characters, ``piece``.

    ``df`` has ``record_table`` and ``record_key``; other columns are left alone and not read. Null and
    empty texts and texts within the limit give no rows; equal rows give equal pieces. Each row is cut on
    its own, so nothing is shuffled; with ``chars`` the rows within the limit never reach Python.
    """
    rows = df.select(F.col("record_table"), F.col("record_key").cast("string").alias("record_key"), F.col(text).alias("text"))
    rows = rows.where(F.length("text") > limit)

    def cut(b: dict[str, list]) -> dict[str, list]:
        out = {k: [] for k in ("record_table", "record_key", "piece_no", "start_pos", "end_pos", "piece")}
        for t, k, s in zip(b["record_table"], b["record_key"], b["text"]):
            parts = spans(s, limit, overlap, unit)
            if len(parts) < 2:
                continue
            for i, (x, y) in enumerate(parts):
                for c, v in zip(out, (t, k, i + 1, x, y, s[x:y])):
                    out[c].append(v)
        return out

    return map_columns(rows, cut, "record_table string, record_key string, piece_no int, start_pos int, end_pos int, piece string")
