"""Problem 9: long exact spans shared between records, by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import mix

#: Characters that the gear hash covers: a 32-bit hash that shifts one bit a character forgets the 33rd.
GEAR = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gear_hashes(codes: np.ndarray) -> np.ndarray:
    """The rolling hash h = (h << 1) + gear[c] mod 2^32 at each character, from its last GEAR characters.

    gear is a hash of the character's code. The sum over the last w characters
    doubles w in each of five rounds, so there is no loop over characters. The
    result is mixed, since the low bits of such a sum depend on few characters.
    """
    h = (mix((codes.astype(np.uint64) + np.uint64(1)) * _ODD) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    w = 1
    while w < GEAR:
        shifted = h.copy()
        shifted[w:] += h[:-w] << np.uint32(w)
        h, w = shifted, 2 * w
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    return h


def chunk_reach(least: int) -> int:
    """The window r for spans of ``least`` characters.

    Two neighbouring ends lie at most r apart and an end occurs in every run of
    r places; with r - 1 places of context on either side and GEAR characters
    in front, any 4 r + GEAR characters hold a whole chunk and what fixes it.
    """
    return max(1, (least - GEAR) // 4)


def cut_points(codes: np.ndarray, r: int) -> np.ndarray:
    """Content-defined ends of chunks: the places whose hash is the least of some window of r places (the last of equal ones)."""
    n = len(codes) - r + 1
    if n < 1:
        return np.zeros(0, np.int64)
    low = gear_hashes(codes).astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(len(codes), dtype=np.uint64))
    w = 1
    while w < r:  # the least of windows of w places, doubled
        step = min(w, r - w)
        low = np.minimum(low[:-step], low[step:])
        w += step
    at = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def _powers(n: int, base: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        out[have : 2 * have] = out[: min(have, n - have)] * step
        have *= 2
    return out


_BASE = 0x5851F42D4C957F2D
#: Characters that are hashed in one go: the batch's texts are laid end to end, so short texts cost no calls of their own.
_TOGETHER = 1 << 19
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def prints(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, begin, digest) of the chunks of some texts.

    A digest covers a chunk and the context that fixes its two ends, about
    least / 2 + chunk characters; chunks whose context crosses the end of their
    text are left out, so no digest depends on the texts beside.
    """
    r = chunk_reach(least)
    codes = _codes("".join(texts))
    ends = np.cumsum([len(t) for t in texts])
    cuts = cut_points(codes, r)
    begin, end = cuts[:-1] - (r - 1) - (GEAR - 1), cuts[1:] + r
    whose = np.searchsorted(ends, cuts[:-1], side="right")
    starts = np.concatenate([[0], ends])
    inside = (begin >= starts[whose]) & (end <= starts[whose + 1]) if len(cuts) > 1 else np.zeros(0, bool)
    begin, end, whose = begin[inside], end[inside], whose[inside]
    size = 1 << max(16, len(codes).bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = _powers(size + 1, _BASE), _powers(size + 1, pow(_BASE, -1, 1 << 64))
    up, down = _TABLES[size]
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + _ODD) * up[: len(codes)], out=total[1:])
    digest = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _ODD)
    return whose, begin - starts[whose], digest.view(np.int64)


def _print_rows(least: int):
    def hashed(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        whose, _, digest = prints(texts, least)
        order = np.lexsort((digest, whose))
        digest, whose = digest[order], whose[order]
        once = np.ones(len(whose), bool)
        once[1:] = (digest[1:] != digest[:-1]) | (whose[1:] != whose[:-1])
        return pa.RecordBatch.from_arrays([pa.array(digest[once]), pa.array(np.array(ids, np.int64)[whose[once]])], names=["digest", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(key)
                texts.append(text)
                held += len(text)
                if held >= _TOGETHER:
                    yield hashed(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield hashed(ids, texts)

    return run


def common_runs(text_a: str, text_b: str, least: int) -> list[tuple[int, int, int]]:
    """(begin in a, begin in b, length) of the maximal common runs of at least ``least`` characters, by their shared chunks."""
    a, b, out = _codes(text_a), _codes(text_b), []
    _, pa_, da = prints([text_a], least)
    _, pb_, db = prints([text_b], least)
    where: dict[int, list[int]] = {}
    for d, j in zip(db.tolist(), pb_.tolist()):
        where.setdefault(d, []).append(j)
    shifts: dict[int, list[int]] = {}
    for d, i in zip(da.tolist(), pa_.tolist()):
        for j in where.get(d, ()):
            shifts.setdefault(j - i, []).append(i)
    for shift, places in sorted(shifts.items()):
        lo, hi = max(0, -shift), min(len(a), len(b) - shift)
        same = np.concatenate([[False], a[lo:hi] == b[lo + shift : hi + shift], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])  # runs of equal characters on this diagonal: begin, end, begin, ...
        begin, end = edges[::2] + lo, edges[1::2] + lo
        for k in np.unique(np.searchsorted(begin, np.array(places), side="right") - 1).tolist():
            if k >= 0 and end[k] - begin[k] >= least:
                out.append((int(begin[k]), int(begin[k]) + shift, int(end[k] - begin[k])))
    return out


_SPANS = "doc_a long, doc_b long, begin_a int, begin_b int, length int"


def _verify(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_a, doc_b, *s) for doc_a, doc_b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns)) for s in common_runs(text_a, text_b, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.int32()] * 3)], names=["doc_a", "doc_b", "begin_a", "begin_b", "length"])

    return run


def shared_spans(documents: DataFrame, least: int = 320, salt: int = 32) -> DataFrame:
    """Spans of at least ``least`` characters that stand verbatim in two documents.

    documents (doc_id, text). Returns doc_a < doc_b, begin_a, begin_b, length:
    the maximal spans of every pair of documents.

    Texts are cut at content-defined places; a chunk's digest covers it and the
    context that fixes its ends, so every span of that length holds a digest
    that both documents have, wherever the span lies in them. Documents that
    share a digest are compared character by character, from all places of
    their common chunks.

    Null ids, null and shorter texts have no spans. Rows of one doc_id are
    taken as one document's if equal; unlike texts under one id are compared
    each with other ids, not with one another. least must be 64 at least.
    A passage may stand in most documents: the pairs are then the result
    itself, and they are made between blocks of such a digest's documents, up
    to ``salt`` on either side, not in one task.
    """
    if least < 64:
        raise ValueError("least must be 64 at least")
    own = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).select(F.col("doc_id").cast("long").alias("doc"), "text")
    marks = own.mapInArrow(_print_rows(least), "digest long, doc long")
    # a digest of one document only, as nearly all are, ends here
    known = marks.groupBy("digest").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("digest", "c")
    spread = marks.join(known, "digest").withColumn("m", F.least(F.lit(salt), F.ceil(F.col("c") / 512)).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    left = spread.select("digest", F.col("doc").alias("doc_a"), F.col("own").alias("s"), other.alias("t"))
    right = spread.select("digest", F.col("doc").alias("doc_b"), F.col("own").alias("t"), other.alias("s"))
    pairs = left.join(right, ["digest", "s", "t"]).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()
    both = pairs.join(own.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a")), "doc_a").join(own.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")
    return both.select("doc_a", "doc_b", "text_a", "text_b").mapInArrow(_verify(least), _SPANS).distinct()


def shared_share(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """For each document with spans: doc_id, n_chars, shared_chars (characters in some span, each once), share."""
    each = spans.select(F.col("doc_a").alias("doc_id"), F.col("begin_a").alias("b"), "length").unionByName(spans.select(F.col("doc_b").alias("doc_id"), F.col("begin_b").alias("b"), "length"))
    each = each.select("doc_id", "b", (F.col("b") + F.col("length")).alias("e")).distinct()
    before = W.partitionBy("doc_id").orderBy("b", "e").rowsBetween(W.unboundedPreceding, -1)
    fresh = each.withColumn("until", F.coalesce(F.max("e").over(before), F.lit(0))).select("doc_id", F.greatest(F.lit(0), F.col("e") - F.greatest("b", "until")).alias("n"))
    covered = fresh.groupBy("doc_id").agg(F.sum("n").alias("shared_chars"))
    sizes = documents.groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    return sizes.join(covered, "doc_id").select("doc_id", "n_chars", "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("share"))
