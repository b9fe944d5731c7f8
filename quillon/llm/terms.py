"""Problem 6: how characteristic a term is of a record, by probabilistic relevance weighting."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, latest, words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, terms, tfs, lengths = [], [], [], []
        for key, text in zip(*(c.to_pylist() for c in batch.columns)):
            counts = Counter(words(text))
            ids.append(key)
            terms.append(list(counts))
            tfs.append(list(counts.values()))
            lengths.append(counts.total())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32())), pa.array(lengths, pa.int64())],
            names=["id", "terms", "tfs", "dl"],
        )


def text_terms(items: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """(id, field, dl, term, tf): the distinct words of each text, counted without a shuffle. Null texts have none."""
    own = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("t"))
    counted = own.mapInArrow(_count, "id string, terms array<string>, tfs array<int>, dl long")
    return counted.select("id", F.lit(field).alias("field"), "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("id", "field", "dl", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))


def tag_terms(items: DataFrame, key: str, tags: str, field: str) -> DataFrame:
    """(id, field, dl, term, tf): the tags of each item, trimmed and lower-cased; null and empty tags are none."""
    clean = F.filter(F.transform(F.col(tags), lambda t: F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))), lambda t: t.isNotNull() & (t != ""))
    own = items.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), clean.alias("all"))
    each = own.select("id", F.size("all").cast("long").alias("dl"), "all", F.explode(F.array_distinct("all")).alias("term"))
    return each.select("id", F.lit(field).alias("field"), "dl", "term", F.size(F.filter("all", lambda t: t == F.col("term"))).alias("tf"))


def score_terms(terms: DataFrame, sizes: DataFrame, k1: float = 1.2, b: float = 0.75, head_share: float = 0.001) -> DataFrame:
    """Weigh every (id, field, term) against the whole collection of its field.

    terms: (id, field, dl, term, tf), distinct in id, field and term; sizes:
    (field, n), the number of items of each field, few rows. Returns id, field,
    term, tf, df (items with the term) and score =
    ln(1 + (n - df + 1/2) / (df + 1/2)) * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)).

    Document frequencies and lengths cover all rows. Terms in more than
    ``head_share`` of the items are at most (mean distinct terms per item) /
    head_share in number, whatever the size of the collection: that head is
    broadcast and its rows, nearly all, are not shuffled. Rows of the rare
    terms meet their frequency in a shuffled join, where no term has more than
    that share of the rows.
    """
    freq = terms.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("all_tf"))
    total = freq.groupBy("field").agg(F.sum("all_tf").alias("total"))
    n = F.broadcast(total.join(sizes, "field").select("field", "n", (F.col("total") / F.col("n")).alias("avgdl")))  # a row a field
    limited = freq.drop("all_tf").join(n, "field")
    head = F.broadcast(limited.where(F.col("df") > F.col("n") * head_share).select("field", "term", "df"))
    tail = limited.where(F.col("df") <= F.col("n") * head_share).select("field", "term", "df")
    common = terms.join(head, ["field", "term"])
    rare = terms.join(head.drop("df"), ["field", "term"], "left_anti").join(tail, ["field", "term"])
    names = ("id", "field", "dl", "term", "tf", "df")
    both = common.select(*names).unionByName(rare.select(*names)).join(n, "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return both.select("id", "field", "term", "tf", "df", (idf * saturated).alias("score"))


def memory_terms(memories: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """score_terms over field ``content`` (words) and field ``tags`` of the latest version of each memory.

    n counts all memories with a content (with tags that are not null) and dl
    all words of a content (all tags of a memory). Null contents, null tag
    lists and texts without a word give no rows; an empty table gives none.
    """
    own = latest(memories, "content", "tags")
    terms = durable(text_terms(own, "id", "content", "content").unionByName(tag_terms(own, "id", "tags", "tags")))  # counted once, read for each statistic
    has = F.explode(F.array(F.struct(F.lit("content").alias("field"), F.col("content").isNotNull().cast("long").alias("c")), F.struct(F.lit("tags").alias("field"), F.col("tags").isNotNull().cast("long").alias("c"))))
    sizes = own.select(has.alias("x")).groupBy("x.field").agg(F.sum("x.c").alias("n"))
    return score_terms(terms, sizes, k1, b).withColumnRenamed("id", "memory_id")
