"""Problem 2: cutting oversized texts at natural boundaries, with overlap, by pointer doubling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BREAK = re.compile(r"\r\n|\r|\n")
_SPACE = re.compile(r"\s+")


def _solid(text: str) -> np.ndarray:
    """For each prefix length 0..n the number of non-whitespace characters in it."""
    out = np.ones(len(text) + 1, np.int64)
    out[0] = 0
    for m in _SPACE.finditer(text):
        out[m.start() + 1 : m.end() + 1] = 0
    return np.cumsum(out)


def _boundaries(text: str, solid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the text may be cut, and whether each is the start of a line (or the end).

    Line starts; inside a line of more than ``most`` also the starts of words;
    inside a word of more than ``most`` every character.
    """
    lines = sorted({0, len(text), *(m.end() for m in _BREAK.finditer(text))})
    at, natural = [], []
    for a, b in zip(lines, lines[1:]):
        at.append(a)
        natural.append(True)
        if solid[b] - solid[a] <= most:
            continue
        starts = [a, *(a + m.end() for m in _SPACE.finditer(text[a:b]) if a + m.end() < b), b]
        for x, y in zip(starts, starts[1:]):
            if x > a:
                at.append(x)
                natural.append(False)
            if solid[y] - solid[x] > most:
                at.extend(range(x + 1, y))
                natural.extend([False] * (y - x - 1))
    at.append(len(text))
    natural.append(True)
    return np.array(at, np.int64), np.array(natural)


def _successors(text: str, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries, the farthest legal successor of each, and where a piece that follows each begins.

    A piece that follows boundary i repeats the ``overlap`` lines before i, or
    as many of them as leave room for one step; with none of them one step
    always fits.
    """
    solid = _solid(text)
    at, natural = _boundaries(text, solid, most)
    n = len(at)
    size = solid[at]
    last = np.maximum.accumulate(np.where(natural, np.arange(n), 0))  # the last line start at or before i
    lines = np.flatnonzero(natural)
    nth = np.searchsorted(lines, np.arange(n), side="right") - 1
    farthest = np.searchsorted(size, size + most, side="right") - 1
    # among the places in reach a line start comes before a place inside a line
    by_line = last[farthest]
    succ = np.where(by_line > np.arange(n), by_line, farthest)
    begin = np.arange(n)
    for o in range(1, overlap + 1):
        # one line back: from a line start the line before, from inside a line its own start
        back = lines[np.maximum(0, np.where(natural, nth - o, nth - o + 1))]
        reach = np.searchsorted(size, size[back] + most, side="right") - 1
        reach = np.where(last[reach] > np.arange(n), last[reach], np.where(natural, -1, reach))
        fits = (reach > np.arange(n)) & (np.arange(n) > 0)
        succ, begin = np.where(fits, reach, succ), np.where(fits, back, begin)
    succ = np.maximum(succ, np.minimum(np.arange(n) + 1, n - 1))
    succ[-1] = n - 1
    return at, succ, begin, solid


def _reachable(succ: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All places on the successor chains from ``starts``, by squaring the successor table: log2(longest chain) rounds."""
    on = np.zeros(len(succ), bool)
    on[starts] = True
    while True:
        more = on.copy()
        more[succ[on]] = True
        further = succ[succ]
        if (further == succ).all() and (more == on).all():
            return on
        on, succ = more, further


def cut(texts: list[str], mosts: list[int], overlaps: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text number, piece number, begin, own begin, end, size) of the pieces of each text.

    The successor tables of all texts are laid end to end and squared together.
    """
    tables, base, parts = [], 0, []
    for text, most, overlap in zip(texts, mosts, overlaps):
        at, succ, begin, solid = _successors(text, max(1, most), max(0, overlap))
        tables.append(succ + base)
        parts.append((base, at, succ, begin, solid))
        base += len(succ)
    if not base:
        return
    on = _reachable(np.concatenate(tables), np.array([p[0] for p in parts]))
    for t, (first, at, succ, begin, solid) in enumerate(parts):
        chosen = np.flatnonzero(on[first : first + len(at)])
        for piece, i in enumerate(chosen[:-1] if len(chosen) > 1 else chosen[:0]):
            a, b = int(at[begin[i]]), int(at[succ[i]])
            yield t, piece, a, int(at[i]), b, int(solid[b] - solid[a])


_PIECES = "chunk_id string, piece int, pieces int, begin int, own_begin int, end int, size int, line_start int, text string"
#: Characters of text whose successor tables are squared together.
_TOGETHER = 1 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(group):
        rows: list[tuple] = []
        found = list(cut([g[1] for g in group], [g[2] for g in group], [g[3] for g in group]))
        count: dict[int, int] = {}
        for t, *_ in found:
            count[t] = count.get(t, 0) + 1
        for t, piece, a, own, b, size in found:
            chunk_id, text, _, _, line = group[t]
            rows.append((chunk_id, piece, count[t], a, own, b, size, None if line is None else line + len(_BREAK.findall(text, 0, a)), text[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = [pa.string(), *[pa.int32()] * 7, pa.string()]
    for batch in batches:
        group, held = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            group.append(row)
            held += len(row[1])
            if held >= _TOGETHER:
                yield flush(group)
                group, held = [], 0
        if group:
            yield flush(group)


def non_whitespace(column: str) -> F.Column:
    """Characters other than whitespace of any script (code points)."""
    return F.length(F.regexp_replace(column, r"(?U)[\s\x1c-\x1f]+", ""))


def split_oversized(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """The pieces of every chunk whose text exceeds the ``max_chunk_size`` of its configuration.

    Returns chunk_id, piece (0, 1, ...), pieces, begin and end (characters of
    the text that the piece spans), own_begin (where what it does not repeat
    begins), size (non-whitespace characters, at most max_chunk_size),
    line_start and text. The pieces without what they repeat give the text
    again, end to end.

    A cut falls on a line start (after any of the three line ends); inside a
    line only if the line alone exceeds the size, then at a word; inside a word
    only if the word alone exceeds it. A piece repeats ``overlap_lines`` lines,
    fewer only where these leave no room for one line more.

    A chunk whose lang is null or not listed takes the row ``*``; without such
    a row it is left out, as are null texts, texts within the size and
    configurations with a null size; sizes below 1 count as 1, null overlaps as
    0. Exact copies of a row count once; rows of one id with unlike texts are
    each cut. Further columns are ignored. No shuffle but that of the copies.
    """
    own = chunks.select(F.col("id").alias("chunk_id"), "text", "line_start", F.col("lang").alias("_lang")).where(F.col("text").isNotNull())
    sizes = configs.where(F.col("max_chunk_size").isNotNull()).groupBy(F.col("lang").alias("_lang")).agg(F.min(F.struct("max_chunk_size", "overlap_lines")).alias("_own"))
    rest = sizes.where(F.col("_lang") == "*").select(F.lit(1).alias("_all"), F.col("_own").alias("_rest"))
    found = (
        own.join(sizes, "_lang", "left")
        .withColumn("_all", F.lit(1))
        .join(rest, "_all", "left")
        .withColumn("_c", F.coalesce("_own", "_rest"))
        .where("_c IS NOT NULL")
        .where(non_whitespace("text") > F.greatest(F.lit(1), F.col("_c.max_chunk_size")))
        .select("chunk_id", "text", F.greatest(F.lit(1), F.col("_c.max_chunk_size")).alias("most"), F.coalesce(F.col("_c.overlap_lines"), F.lit(0)).alias("overlap"), "line_start")
        .distinct()
    )
    return found.mapInArrow(_pieces, _PIECES)
