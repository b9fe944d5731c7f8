"""Problem 8: mixing sources to target shares of all tokens, by Pareto order sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the installed public byte-level BPE; both are parameters of count_tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def count_tokens(documents: DataFrame, key: str, text: str, *keep: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, the kept columns, and tokens: how many ids a public tokenizer gives the whole text. Null texts have 0."""
    if path is None or pattern is None:
        path, pattern = public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(path, pattern)
        for batch in batches:
            sizes = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    own = documents.select(key, *keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]), "tokens bigint"])
    return own.mapInArrow(run, schema)


def norm_source(c: str) -> Column:
    """Sources are compared without outer white space and letter case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def plan_shares(sized: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """A row for each listed source: what it has, what it should give and what it can.

    sized (source, tokens), targets (source, target_share, max_repeats).
    Returns source, docs, tokens, target_tokens (target_share of the tokens of
    all documents of listed sources), most_tokens (max_repeats of its own),
    reachable, and copies = target_tokens / tokens, at most max_repeats (0
    without documents). budget: the tokens of the whole mix, where it is not to
    be those of all documents; a source that falls short leaves the others at
    their tokens, so that their shares come out larger (see shares_reached). Rows of one source in targets add up their shares and
    take the smallest max_repeats; null shares count as 0, null repeats as 1,
    null sources are left out.
    """
    own = sized.groupBy(norm_source("source").alias("source")).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    listed = targets.where(F.col("source").isNotNull()).groupBy(norm_source("source").alias("source")).agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("max_repeats"))
    have = listed.join(own, "source", "left").fillna(0, ["docs", "tokens"])
    whole = have.agg(F.sum("tokens").alias("budget"))  # one row
    full = (have.crossJoin(F.broadcast(whole)) if budget is None else have.withColumn("budget", F.lit(float(budget)))).withColumn("target_tokens", F.col("target_share") * F.col("budget")).withColumn("most_tokens", F.col("max_repeats") * F.col("tokens"))
    copies = F.when(F.col("tokens") > 0, F.least(F.col("target_tokens") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return full.select("source", "docs", "tokens", "target_share", "max_repeats", "target_tokens", "most_tokens", (F.col("most_tokens") >= F.col("target_tokens")).alias("reachable"), copies.alias("copies"))


#: Cells of the random rank in which tokens are summed up to find where a source's sample ends.
_CELLS = 1 << 14


def _scale(share: DataFrame, w: Column) -> DataFrame:
    """(source, scale): the factor by which the weights of a source become inclusion probabilities that add up to its quota of tokens.

    p = min(1, scale * weight). Documents that would exceed 1 are certain, which
    leaves less for the others: the factor grows from round to round until no
    further document becomes certain; each round has a row a source.
    """
    known = None
    while True:
        base = share.withColumn("w", w) if known is None else share.withColumn("w", w).join(F.broadcast(known), "source", "left")
        sure = F.lit(False) if known is None else F.coalesce(F.col("w") * F.col("scale") >= 1, F.lit(False))
        rest = base.groupBy("source").agg(F.max("quota").alias("quota"), F.coalesce(F.sum(F.when(sure, F.col("tokens"))), F.lit(0)).alias("held"), F.sum(F.when(~sure, F.col("w") * F.col("tokens"))).alias("open"))
        new = rest.select("source", F.when(F.col("open") > 0, F.greatest(F.lit(0.0), F.col("quota") - F.col("held")) / F.col("open")).otherwise(1e18).alias("scale"))
        rows = {r["source"]: r["scale"] for r in new.collect()}  # a row a source of the plan
        before = {} if known is None else {r["source"]: r["scale"] for r in known.collect()}
        grown = {k: max(v, before.get(k, 0.0)) for k, v in rows.items()}
        known = share.sparkSession.createDataFrame(list(grown.items()), "source string, scale double")
        if all(grown[k] <= before.get(k, -1.0) * (1 + 1e-12) for k in grown):
            return known


def mix_sources(sized: DataFrame, plan: DataFrame, seed: int = 0, weight: str | None = None) -> DataFrame:
    """How often each document goes into the mix: doc_id, source, tokens, copies (at least 1).

    sized: distinct (doc_id, source, tokens[, weight]); plan: plan_shares. A
    source that needs r copies of its tokens gets floor(r) whole copies of
    every document (these are certain); the rest is an order sample: documents
    are ranked by random odds u/(1-u) over inclusion odds p/(1-p) and taken
    from the front until the source's tokens are nearest to its target. p is
    the fraction that is left; with ``weight`` (not negative, null as 1) it is
    proportional to the weight, scaled so that the expected tokens are the
    quota, and 1 for documents too heavy for that, which come first. u is a
    hash of doc_id and seed, so a mix can be repeated, and documents stay chosen
    as the share grows.

    No document exceeds max_repeats. Documents of sources not listed, of null
    source or id and without tokens are not in the mix. A source may hold most
    of all rows: tokens are summed up per cell of the rank, and only the one
    cell in which the sample ends is ranked row by row.
    """
    own = sized.where(F.col("doc_id").isNotNull() & (F.col("tokens") > 0)).withColumn("source", norm_source("source"))
    terms = plan.where(F.col("copies") > 0).select("source", "copies", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("part"), (F.col("tokens") * (F.col("copies") - F.floor("copies"))).alias("quota"))
    share = own.join(terms, "source")
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    chance = F.col("part")
    if weight:
        w = F.greatest(F.lit(0.0), F.coalesce(F.col(weight).cast("double"), F.lit(1.0)))
        share = share.join(F.broadcast(_scale(share, w)), "source")  # a row a source
        chance = w * F.col("scale")
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), chance))
    odds = (u / (1 - u)) / (p / (1 - p))
    ranked = share.withColumn("q", odds / (1 + odds)).withColumn("cell", F.floor(F.col("q") * _CELLS))
    before = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = ranked.groupBy("source", "cell").agg(F.sum("tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)))
    placed = ranked.join(cells.select("source", "cell", "t", "before"), ["source", "cell"])
    inside = (F.col("before") < F.col("quota")) & (F.col("before") + F.col("t") > F.col("quota"))
    run = W.partitionBy("source", "cell").orderBy("q", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    edge = placed.where(inside).withColumn("ahead", F.col("before") + F.coalesce(F.sum("tokens").over(run), F.lit(0))).withColumn("in", (F.col("ahead") + F.col("tokens") / 2 <= F.col("quota")).cast("int"))
    rest = placed.where(~inside).withColumn("in", (F.col("before") + F.col("t") <= F.col("quota")).cast("int"))
    names = ("doc_id", "source", "tokens", (F.col("whole") + F.col("in")).cast("int").alias("copies"))
    return rest.select(*names).unionByName(edge.select(*names)).where("copies > 0")


def shares_reached(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each listed source: source, target_share, share (of the mix's tokens), mix_tokens, max_copies, reachable."""
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("max_copies"))
    every = got.agg(F.sum("mix_tokens").alias("all_tokens"))  # one row
    return (
        plan.select("source", "target_share", "reachable")
        .join(got, "source", "left")
        .crossJoin(F.broadcast(every))
        .select("source", "target_share", (F.coalesce("mix_tokens", F.lit(0)) / F.col("all_tokens")).alias("share"), F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"), "reachable")
    )


def short_of_target(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """(source): listed sources that cannot reach their target.

    Such a source has every document in the mix as often as it may be there,
    and its tokens still are fewer than its target.
    """
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
    have = plan.join(got, "source", "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    return have.where((F.col("mixed") >= F.col("most_tokens")) & (F.col("mixed") < F.col("target_tokens"))).select("source")
