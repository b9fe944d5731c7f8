"""Problem 7: evaluation passages inside training text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, mix, words

_SPANS = "doc_id long, item_id long, first_word int, words int, begin int, end int"
#: n-grams of test items held in one broadcast set; further items take further passes over the corpus.
GRAMS_PER_PASS = 2_000_000

_HASHES = WordHashes()


def gram_hashes(tokens: list[str], n: int) -> np.ndarray:
    """One 64-bit hash per run of n words, from the words' hashes by doubling."""
    h = _HASHES.of(tokens)
    if len(h) < n:
        return h[:0]
    out, width, done = None, 1, 0
    power = h
    while width <= n:  # power[i] covers `width` words from i; the binary digits of n pick which to chain
        if n & width:
            part = power[done:] if done else power
            out = part if out is None else mix(out[: len(part)]) * np.uint64(0x9E3779B97F4A7C15) + part[: len(out)]
            done += width
        power = mix(power[:-width]) * np.uint64(0xC2B2AE3D27D4EB4F) + power[width:] if len(power) > width else power[:0]
        width *= 2
    return out[: len(h) - n + 1]


class Grams:
    """The normalised n-grams of test items: their hashes in order for the scan, where each stands, and the items' words to verify hits.

    Arrays of 16 bytes a gram, which every worker holds.
    """

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.keys = [k for k, _ in items]
        self.tokens = [words(t) for _, t in items]
        grams = [gram_hashes(t, n) for t in self.tokens]
        hashes = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(g), dtype=np.int32) for g in grams)])[order]

    def hits(self, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
        """(item, first word, words): the maximal runs of the tokens whose every n-gram is one of the item's, verified word by word."""
        grams = gram_hashes(tokens, self.n)
        if not len(grams) or not len(self.hashes):
            return
        low = np.searchsorted(self.hashes, grams)
        hit = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == grams)
        high = np.searchsorted(self.hashes, grams[hit], side="right")
        found: dict[int, list[int]] = defaultdict(list)
        for i, a, b in zip(hit.tolist(), low[hit].tolist(), high.tolist()):
            for k, j in zip(self.item[a:b].tolist(), self.place[a:b].tolist()):
                if self.tokens[k][j : j + self.n] == tokens[i : i + self.n] and (not found[k] or found[k][-1] != i):
                    found[k].append(i)
        for k, starts in found.items():
            if not starts:
                continue
            first = last = starts[0]
            for i in starts[1:]:
                if i > last + 1:
                    yield self.keys[k], first, last - first + self.n
                    first = i
                last = i
            yield self.keys[k], first, last - first + self.n


def _scan(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Grams = shared.value
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = words(text)
                hits = list(grams.hits(tokens))
                if not hits:
                    continue
                low = text.lower()
                exact = len(low) == len(text)  # else lower-casing moved the characters, and places are given in words only
                spots = [m.span() for m in WORD.finditer(low)] if exact else None
                for k, first, count in hits:
                    rows.append((key, k, first, count, spots[first][0] if exact else None, spots[first + count - 1][1] if exact else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), *[pa.int32()] * 4])], names=["doc_id", "item_id", "first_word", "words", "begin", "end"])

    return run


def leaked_spans(documents: DataFrame, items: DataFrame, n: int = 12, grams_per_pass: int = GRAMS_PER_PASS) -> DataFrame:
    """Where documents repeat at least n consecutive words of a test item.

    documents (doc_id, text), items (item_id, text). Returns doc_id, item_id,
    first_word and words (the run in the document whose every n-gram stands in
    the item), begin and end (its characters; null in the rare text whose
    length changes with letter case).

    The hashed n-grams of the items are broadcast; a hit is verified word by
    word. At most ``grams_per_pass`` n-grams are held at once: more items are
    scanned for in blocks, one pass over the corpus each, so the broadcast is
    bounded whatever their number. Items are read to the driver block by block.

    Null or empty texts and items of fewer than n words give no rows. Items of
    equal text are each reported. Rows of one doc_id are scanned each; equal
    findings come once.
    """
    spark = documents.sparkSession
    corpus = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    questions = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    passes: list[DataFrame] = []

    def scan(block: list[tuple[int, str]]) -> None:
        shared = spark.sparkContext.broadcast(Grams(block, n))
        passes.append(corpus.mapInArrow(_scan(shared), _SPANS))

    block, held = [], 0
    for row in questions.toLocalIterator():
        size = max(0, len(words(row.text)) - n + 1)
        if size:
            if block and held + size > grams_per_pass:
                scan(block)
                block, held = [], 0
            block.append((row.item_id, row.text))
            held += size
    if block or not passes:
        scan(block)
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out.distinct()


def without_spans(documents: DataFrame, spans: DataFrame, at_most: float = 0.3) -> DataFrame:
    """The documents (doc_id, text, removed) without their leaked spans; those of which more than ``at_most`` leaked are left out.

    Overlapping spans are joined first. A document with a span whose place in
    characters is unknown is left out whole.
    """
    cuts = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("cuts"), F.max(F.col("begin").isNull()).alias("vague"))
    # fold the sorted cuts over the text: (text so far, end of the last cut)
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    fold = F.aggregate(
        "cuts",
        start,
        lambda acc, c: F.struct(
            F.concat(acc["kept"], F.when(c["begin"] > acc["at"], F.substr(F.col("text"), acc["at"] + 1, c["begin"] - acc["at"])).otherwise(F.lit(""))).alias("kept"),
            F.greatest(acc["at"], c["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["kept"], F.substr(F.col("text"), acc["at"] + 1)),
    )
    joined = documents.select("doc_id", "text").join(cuts, "doc_id", "left")
    kept = joined.where(~F.coalesce("vague", F.lit(False))).withColumn("clean", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(fold))
    removed = F.length("text") - F.length("clean")
    return kept.withColumn("removed", F.coalesce(removed, F.lit(0))).where(F.col("removed") <= F.coalesce(F.length("text"), F.lit(0)) * at_most).select("doc_id", F.col("clean").alias("text"), "removed")
