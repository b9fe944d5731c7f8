"""Problem 3: duplicates hidden by formatting, by bottom-up hashing of nested records."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, latest, words

_PAIR = re.compile(r"^[\s>*•-]*([^=;:\n]{1,80}?)\s*=(.*)$", re.S)
_LINE = re.compile(r"^[\s>*•-]*([^:=\n]{1,80}?)\s*:(.*)$")


def _digest(*parts: bytes) -> bytes:
    h = xxhash.xxh3_128()
    for p in parts:
        h.update(len(p).to_bytes(4, "little"))
        h.update(p)
    return h.digest()


class Node:
    """A normalised tree: a leaf of words, an ordered list or an unordered set of fields. Knows its digest and its canonical form."""

    __slots__ = ("digest", "form")

    def __init__(self, digest: bytes, form: str):
        self.digest, self.form = digest, form

    @classmethod
    def leaf(cls, text: str) -> Node:
        form = " ".join(words(text))
        return cls(_digest(b"w", form.encode()), form)

    @classmethod
    def ordered(cls, children: list[Node]) -> Node:
        return cls(_digest(b"l", *(c.digest for c in children)), "[" + ",".join(c.form for c in children) + "]")

    @classmethod
    def unordered(cls, kind: str, fields: list[tuple[Node, Node]]) -> Node:
        """Equal fields count once; the order of the digests is the order of the canonical form."""
        own = {}
        for name, value in fields:
            own[_digest(b"f", name.digest, value.digest)] = f"{name.form}={value.form}"
        order = sorted(own)
        return cls(_digest(kind.encode(), *order), kind + "{" + ";".join(own[d] for d in order) + "}")


def _json_node(value: object) -> Node:
    if isinstance(value, dict):
        return Node.unordered("json", [(Node.leaf(str(k)), _json_node(v)) for k, v in value.items()])
    if isinstance(value, list):
        return Node.ordered([_json_node(v) for v in value])
    if value is None or isinstance(value, bool):
        return Node.leaf(json.dumps(value))
    return Node.leaf(str(value))


def record(text: str) -> Node | None:
    """The tree of a field record: a JSON object, ``name=value; ...`` or ``Name: value`` lines of two fields at least; else none."""
    inner = text.strip()
    if inner.startswith("{") and inner.endswith("}"):
        try:
            value = json.loads(inner, parse_int=str, parse_float=str)
        except (ValueError, RecursionError):
            value = None
        if isinstance(value, dict):
            return _json_node(value)
    if "=" in inner and ";" in inner:
        parts = [_PAIR.match(p) for p in inner.split(";") if WORD.search(p)]
        if len(parts) > 1 and all(parts):
            return Node.unordered("pairs", [(Node.leaf(m[1]), Node.leaf(m[2])) for m in parts])
    if ":" in inner and ("\n" in inner or "\r" in inner):
        parts = [_LINE.match(p) for p in inner.splitlines() if WORD.search(p)]
        if len(parts) > 1 and all(parts):
            return Node.unordered("lines", [(Node.leaf(m[1]), Node.leaf(m[2])) for m in parts])
    return None


_DIGESTS = "id string, seq binary, rec binary"
_FORMS = "seq binary, seq_form string, rec binary, rec_form string"


def _trees(batches: Iterator[pa.RecordBatch], row, kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [row(key, Node.leaf(text), record(text)) for key, text in zip(*(c.to_pylist() for c in batch.columns))]
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _trees(batches, lambda k, s, r: (k, s.digest, r and r.digest), [pa.string(), pa.binary(), pa.binary()], ["id", "seq", "rec"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _trees(batches, lambda k, s, r: (s.digest, s.form, r and r.digest, r and r.form), [pa.binary(), pa.string()] * 2, ["seq", "seq_form", "rec", "rec_form"])


def _classes(digests: DataFrame) -> DataFrame:
    """(seq, class) of the sequences of words that share a record with another; class is the least digest that is reached.

    Nearly always one step reaches all; a further round is run only while some
    sequence has records of unlike classes.
    """
    pairs = digests.where(F.col("rec").isNotNull()).select("seq", "rec").distinct()
    linked = pairs.groupBy("rec").agg(F.min("seq").alias("class"), F.max("seq").alias("last")).where("class <> last").drop("last")
    pairs = durable(pairs.join(linked, "rec"))
    while True:
        best = pairs.groupBy("seq").agg(F.min("class").alias("class"), F.max("class").alias("other"))
        if not best.where("class <> other").limit(1).count():
            return best.select("seq", "class")
        moved = pairs.drop("class").join(best.drop("other"), "seq")
        least = moved.groupBy("rec").agg(F.min("class").alias("class"))
        pairs = durable(moved.drop("class").join(least, "rec"))


def classes_of(digests: DataFrame, *keep: str) -> DataFrame:
    """id, class_id and the kept columns of (id, seq, rec, ...)."""
    return digests.join(_classes(digests), "seq", "left").select("id", F.coalesce("class", "seq").alias("class_id"), *keep)


def _confirmed(members: DataFrame, own: DataFrame) -> DataFrame:
    """One row (ok) that is true; fails if texts that were grouped have unlike canonical forms under one digest.

    All members of groups of two or more are compared: least and greatest form
    under a digest are equal only if all are.
    """
    forms = own.join(members.where("copies > 1").select("id"), "id", "left_semi").select("id", "t").mapInArrow(_forms, _FORMS)
    each = forms.select(F.posexplode(F.array(F.struct(F.col("seq").alias("d"), F.col("seq_form").alias("f")), F.struct(F.col("rec").alias("d"), F.col("rec_form").alias("f")))).alias("kind", "x"))
    unlike = each.where("x.d IS NOT NULL").groupBy("kind", "x.d").agg(F.min("x.f").alias("lo"), F.max("x.f").alias("hi")).where("lo <> hi")
    return unlike.agg(F.when(F.count("*") > 0, F.raise_error(F.lit("two canonical forms share a 128-bit digest"))).otherwise(F.lit(True)).cast("boolean").alias("ok"))


def formatted_copies(items: DataFrame, key: str, text: str) -> DataFrame:
    """Every item with the copies it belongs to: those that differ in white space, letter case, punctuation or field order.

    Returns key, rep_id (smallest key of the copies), copies (their number) and
    class_id (digest). Two items are copies if their texts are the same
    sequence of words, or are field records of one shape (JSON object, pairs,
    lines) with the same set of fields; also what such steps connect.

    Items with null key or null text are left out; texts without a word are
    copies of each other; a row that is there twice counts once, rows of one
    key with unlike texts each join the copies of their text. Names are
    compared without order at every level of a JSON object, list elements in
    order. An empty table gives no rows. A class may hold most of all rows:
    its size is an aggregate with map-side combine, and its members meet their
    representative in a join that adaptive execution splits.
    """
    own = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("t"))
    digests = durable(own.mapInArrow(_digests, _DIGESTS))
    joined = classes_of(digests)
    ids = joined.groupBy("class_id", "id").agg(F.lit(1).alias("_1"))
    reps = ids.groupBy("class_id").agg(F.min("id").alias("rep_id"), F.count("*").alias("copies"))
    members = ids.join(reps, "class_id").select("id", "rep_id", "copies", F.hex("class_id").alias("class_id"))
    sure = members.crossJoin(F.broadcast(_confirmed(members, own))).where("ok").drop("ok")  # one row, see _confirmed
    return sure.withColumnRenamed("id", key)


def memory_copies(memories: DataFrame) -> DataFrame:
    """formatted_copies of the latest version of each memory: id, rep_id, copies, class_id."""
    return formatted_copies(latest(memories, "content"), "id", "content")
