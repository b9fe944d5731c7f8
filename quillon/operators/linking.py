"""References, packages, endpoints and events across repositories; pieces of the indexing pipeline."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weight of an edge by its relationship; all others 0.5.
EDGE_WEIGHTS = {
    "CALLS": 1.0, "IMPORTS": 0.5, "CONTAINS": 0.1, "TYPE_DEFINITION": 0.6, "READS": 0.3, "WRITES": 0.4, "OVERRIDES": 0.8,
    "IMPLEMENTS": 0.8, "INHERITS": 0.8, "DEPENDS_ON": 0.7, "CO_CHANGED": 0.6, "EVOLVED_INTO": 0.7, "SUMMARIZES": 0.7, "PART_OF": 0.4,
    "RELATES_TO": 0.3, "SHARES_THEME": 0.3, "HTTP_CALLS": 0.7, "PUBLISHES_TO": 0.6, "SUBSCRIBES_TO": 0.6, "MODIFIED_BY": 0.4,
}


def edge_weight(relationship: Column, override: dict[str, float] | None = None) -> Column:
    pairs = [F.lit(x) for kv in (EDGE_WEIGHTS | (override or {})).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), relationship), F.lit(0.5))


def reference_edges(resolved: DataFrame) -> DataFrame:
    """resolved (src, dst, relationship, confidence) with weight = weight of the relationship * confidence."""
    return resolved.withColumn("weight", edge_weight(F.col("relationship")) * F.col("confidence"))


def _suffixes(column: str) -> Column:
    """The qualified names that a qualified name ends with, itself included."""
    parts = F.split(column, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))


def resolve(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, symbol, confidence): the symbol that each reference (ref_id, name, file_path, kind) means, by the first rule that gives one.

    symbols (symbol, file_path), by qualified name. Rules: the qualified name
    1.0; without ``crate::`` 0.95, as the end of one 0.85; with ``crate::`` in
    front 0.9, as the end of one 0.8 (both for names with ``::``); the last
    segment, if one symbol has it 0.9 (0.7 if the name had more segments), else
    the best of those that have it: 0.3 and half of 0.4 (imported in that file)
    + 0.3 (same file) + 0.2 (whole name) + 0.1 (same folder). Every rule is an
    equi join: ends of names are made on the symbols' side. Ties by length and
    name.
    """
    sym = symbols.groupBy("symbol").agg(F.min("file_path").alias("sf")).withColumn("simple", F.element_at(F.split("symbol", "::"), -1))
    ends = sym.select("symbol", "sf", F.explode(_suffixes("symbol")).alias("end"))
    ref = references.select("ref_id", "name", F.col("file_path").alias("rf")).distinct()
    crate, deep = F.startswith("name", F.lit("crate::")), F.contains("name", F.lit("::"))
    bare = F.regexp_replace("name", "^crate::", "")
    asks = [
        (1, 1.0, F.col("name"), F.lit(True), True),
        (2, 0.95, bare, crate, True),
        (3, 0.85, bare, crate, False),
        (4, 0.9, F.concat(F.lit("crate::"), "name"), deep, True),
        (5, 0.8, F.col("name"), deep, False),
    ]
    hits = None
    for rule, sure, want, where, whole in asks:
        one = ref.where(where).select("ref_id", want.alias("end"), F.lit(rule).alias("rule"), F.lit(sure).alias("confidence"), F.lit(whole).alias("whole"))
        hits = one if hits is None else hits.unionByName(one)
    named = hits.join(ends.select("end", "symbol"), "end").where(~F.col("whole") | (F.col("end") == F.col("symbol"))).select("ref_id", "rule", "confidence", "symbol")
    imports = references.where("kind = 'import'").groupBy(F.col("file_path").alias("rf")).agg(F.collect_set("name").alias("imports"))  # of one file
    alone = sym.groupBy("simple").agg(F.count("*").alias("c"))
    last = ref.withColumn("simple", F.element_at(F.split("name", "::"), -1)).join(sym, "simple").join(alone, "simple").join(imports, "rf", "left")
    folder = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, r"/[^/]*$", "")).otherwise("")
    imported = F.coalesce(F.exists("imports", lambda i: (i == F.col("symbol")) | F.endswith(i, F.col("simple"))), F.lit(False))
    part = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    score = part(imported, 0.4) + part(F.col("sf") == F.col("rf"), 0.3) + part(F.col("simple") == F.col("name"), 0.2) + part(folder(F.coalesce("rf", F.lit(""))) == folder(F.coalesce("sf", F.lit(""))), 0.1)
    sure = F.when(F.col("c") == 1, F.when(F.col("simple") == F.col("name"), 0.9).otherwise(0.7)).otherwise(0.3 + 0.5 * F.least(score, F.lit(1.0)))
    simple = last.select("ref_id", F.lit(6).alias("rule"), F.round(sure, 9).alias("confidence"), "symbol")
    best = named.unionByName(simple).groupBy("ref_id").agg(F.min(F.struct("rule", (-F.col("confidence")).alias("n"), F.length("symbol").alias("l"), "symbol")).alias("m"))
    return best.select("ref_id", F.col("m.symbol").alias("symbol"), (-F.col("m.n")).alias("confidence"))


#: Ends of a host name by which the first segment of an import is a place to fetch it from.
HOST_ENDS = ("com", "org", "io", "net", "dev", "in", "cc", "co")


def package_hint(reference: str = "name", kind: str = "kind", builtin: Sequence[str] = tuple(sorted(sys.stdlib_module_names))) -> Column:
    """The package that an import names, by the shape of the name; null for other kinds, for relative names and for the names in ``builtin``."""
    c = F.col(reference)
    first = lambda sep: F.split_part(c, F.lit(sep), F.lit(1))
    local = c.rlike(r"^(\.|crate::|super::|self::)")
    scoped = F.coalesce(F.nullif(F.regexp_extract(reference, r"^(@[^/]*/[^/]*)", 1), F.lit("")), c)
    host = first("/").rlike(r"\.(" + "|".join(HOST_ENDS) + ")$")
    by_shape = (
        F.when(F.startswith(c, F.lit("@")), scoped)
        .when(F.contains(c, F.lit("/")) & host, c)
        .when(F.contains(c, F.lit("/")) & (first("/") != ""), first("/"))
        .when(F.contains(c, F.lit("::")), first("::"))
        .when(F.contains(c, F.lit(".")), first("."))
        .when(~c.isin(*builtin), c)
    )
    return F.when((F.col(kind) == "import") & ~local, by_shape)


def link_packages(pending: DataFrame, registry: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, namespace, symbol, confidence): pending references (ref_id, namespace, package, name) against packages (package, namespace) of other namespaces and their symbols (namespace, symbol, visibility).

    Exact 1.0, suffix 0.85, simple name 0.7, and 0.05 more for public symbols.
    """
    where = pending.withColumnRenamed("namespace", "own").join(registry.select("package", "namespace").distinct(), "package").where("own <> namespace")
    parts = F.split("symbol", "::")
    names = symbols.select("namespace", "symbol", "visibility", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))).alias("name"))
    hit = where.join(names, ["namespace", "name"])
    base = F.when(F.col("symbol") == F.col("name"), 1.0).when(F.contains("name", F.lit("::")), 0.85).otherwise(0.7)
    conf = F.least(F.lit(1.0), base + F.when(F.col("visibility") == "public", 0.05).otherwise(0.0))
    best = hit.withColumn("confidence", conf).groupBy("ref_id").agg(F.min(F.struct((-F.col("confidence")).alias("n"), F.length("symbol").alias("l"), "symbol", "namespace")).alias("m"))
    return best.select("ref_id", F.col("m.namespace").alias("namespace"), F.col("m.symbol").alias("symbol"), (-F.col("m.n")).alias("confidence"))


def fuse_edges(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, dst, relationship, confidence, fused): edges of two origins; where both have one their confidences add up, 1 at most."""
    one = lambda df, c: df.groupBy("src", "dst", "relationship").agg(F.max("confidence").alias(c))
    j = one(first, "a").join(one(second, "b"), ["src", "dst", "relationship"], "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.select("src", "dst", "relationship", F.least(F.lit(1.0), F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("confidence"), both.alias("fused"))


def normal_path(path: str = "path") -> Column:
    """Route parameters as {name}, one slash in front, none behind."""
    p = F.regexp_replace(path, r"<(?:[^:<>]+:)?([^<>]+)>", "{$1}")
    p = F.regexp_replace(p, r":([A-Za-z_]\w*)", "{$1}")
    p = F.regexp_replace(F.regexp_replace(p, r"/{2,}", "/"), r"(.)/$", "$1")
    return F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))


def match_calls(calls: DataFrame, endpoints: DataFrame, least: float = 0.5) -> DataFrame:
    """(call_id, endpoint_id, confidence): the best endpoint (endpoint_id, method, path) for each client call (call_id, method, url).

    Same path 1.0, same but for parameters 0.9, a prefix of segments 0.7; 0.1
    less for an unknown method; another method does not match. Paths meet on
    their shape (every parameter and number as {}), prefixes are made on the
    calls' side, so each tier is an equi join.
    """
    shape = lambda c: F.regexp_replace(F.regexp_replace(c, r"\{[^}]*\}", "{}"), r"/\d+(?=/|$)", "/{}")
    url = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    own = calls.select("call_id", F.upper("method").alias("m"), normal_path("_u").alias("u")) if "_u" in calls.columns else calls.withColumn("_u", url).select("call_id", F.upper("method").alias("m"), normal_path("_u").alias("u"))
    parts = F.split(shape(F.col("u")), "/")
    prefixes = own.select("call_id", "m", "u", shape(F.col("u")).alias("full"), F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("shape"))
    ends = endpoints.select("endpoint_id", F.upper("method").alias("em"), normal_path("path").alias("p")).withColumn("shape", shape(F.col("p")))
    hit = prefixes.join(ends, "shape").where(F.col("m").isNull() | F.col("em").isNull() | (F.col("m") == F.col("em")))
    conf = F.when(F.col("u") == F.col("p"), 1.0).when(F.col("full") == F.col("shape"), 0.9).otherwise(0.7) - F.when(F.col("m").isNull() | F.col("em").isNull(), 0.1).otherwise(0.0)
    best = hit.withColumn("c", conf).where(F.col("c") >= least).groupBy("call_id").agg(F.min(F.struct((-F.col("c")).alias("c"), (-F.length("p")).alias("l"), "endpoint_id")).alias("x"))
    return best.select("call_id", F.col("x.endpoint_id").alias("endpoint_id"), F.round(-F.col("x.c"), 9).alias("confidence"))


def match_events(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(producer, consumer, confidence): channels of one protocol that are equal 0.95 or meet by a trailing wildcard 0.8; null channels meet nothing.

    The wildcard side is joined on the prefixes of the other, split at . / and :.
    """
    known = lambda df, name: df.where("channel IS NOT NULL AND protocol IS NOT NULL").select(F.col("id").alias(name), "protocol", F.col("channel").alias(name + "_c"))
    p, c = known(producers, "producer"), known(consumers, "consumer")
    equal = p.withColumnRenamed("producer_c", "ch").join(c.withColumnRenamed("consumer_c", "ch"), ["protocol", "ch"]).select("producer", "consumer", F.lit(0.95).alias("confidence"))

    def wild(a: DataFrame, b: DataFrame, an: str, bn: str) -> DataFrame:
        stars = a.where(F.col(an + "_c").rlike(r"\*$")).withColumn("prefix", F.regexp_replace(an + "_c", r"\*+$", ""))
        cuts = F.transform(F.sequence(F.lit(0), F.length(bn + "_c")), lambda i: F.left(F.col(bn + "_c"), i))
        cuts = F.filter(cuts, lambda x: (x == "") | x.rlike(r"[./:]$"))
        return stars.join(b.where(~F.col(bn + "_c").rlike(r"\*$")).withColumn("prefix", F.explode(cuts)), ["protocol", "prefix"]).select("producer", "consumer", F.lit(0.8).alias("confidence"))

    return equal.unionByName(wild(p, c, "producer", "consumer")).unionByName(wild(c, p, "consumer", "producer")).groupBy("producer", "consumer").agg(F.max("confidence").alias("confidence"))


def package_tree(files: DataFrame) -> DataFrame:
    """(src, dst): CONTAINS edges from each folder to its folders and files. files (file_path)."""
    parts = F.split("file_path", "/")
    step = F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("i")
    own = files.where("file_path LIKE '%/%'").select("file_path", parts.alias("p"), step)
    src = F.concat(F.lit("pkg:"), F.array_join(F.slice("p", 1, F.col("i")), "/"))
    dst = F.when(F.col("i") == F.size("p") - 1, F.concat(F.lit("file:"), "file_path")).otherwise(F.concat(F.lit("pkg:"), F.array_join(F.slice("p", 1, F.col("i") + 1), "/")))
    return own.select(src.alias("src"), dst.alias("dst")).distinct()


def stale_symbols(old: DataFrame, new: DataFrame, edges: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (id, file_path) that are gone, and the edges with those between memories and them led to the file instead."""
    gone = old.join(new.select("id"), "id", "left_anti").select("id", "file_path").distinct()
    to = gone.select("id", F.concat(F.lit("file:"), "file_path").alias("_f"))
    mem = memories.select("id", F.lit(True).alias("_m"))
    e = edges.join(to.select(F.col("id").alias("src"), F.col("_f").alias("_fs")), "src", "left").join(to.select(F.col("id").alias("dst"), F.col("_f").alias("_fd")), "dst", "left")
    e = e.join(mem.select(F.col("id").alias("src"), F.col("_m").alias("_ms")), "src", "left").join(mem.select(F.col("id").alias("dst"), F.col("_m").alias("_md")), "dst", "left")
    keep = (F.col("_fs").isNull() | F.col("_md").isNotNull()) & (F.col("_fd").isNull() | F.col("_ms").isNotNull())
    moved = e.where(keep).withColumn("src", F.coalesce("_fs", "src")).withColumn("dst", F.coalesce("_fd", "dst"))
    return gone, moved.select(*edges.columns)


def fan_out_limited(references: DataFrame, most: int) -> DataFrame:
    """References (symbol, file_path, ...) without those of a symbol that is referred to more than ``most`` times in the file: such names say nothing. The rule is the reference data's, not a saving."""
    n = references.groupBy("symbol", "file_path").agg(F.count("*").alias("_n"))
    return references.join(n, ["symbol", "file_path"]).where(F.col("_n") <= most).drop("_n")


def role_relationship() -> Column:
    """Over the boolean columns is_import, is_write, is_read and kind: the relationship a reference stands for, import before write before read before kind."""
    return F.when(F.col("is_import"), "IMPORTS").when(F.col("is_write"), "WRITES").when(F.col("is_read"), "READS").when(F.col("kind").isin("class", "struct", "interface", "type"), "TYPE_DEFINITION").otherwise("CALLS")


def merge_small(chunks: DataFrame, least: int = 50, most: int = 1500) -> DataFrame:
    """Neighbouring chunks of a file folded together while one is below ``least`` and both fit into ``most`` non-whitespace characters.

    chunks (file_path, chunk_index, size, text) -> (file_path, first_index, last_index, size, text). The fold is sequential within a file.
    """
    packed = chunks.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.col("size").cast("long").alias("size"), "text"))).alias("all"))
    item = "array<struct<first:int,last:int,size:bigint,text:string>>"
    one = lambda x: F.struct(x["chunk_index"].alias("first"), x["chunk_index"].alias("last"), x["size"].alias("size"), x["text"].alias("text"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & ((last["size"] < least) | (x["size"] < least)) & (last["size"] + x["size"] <= most)
        joined = F.struct(last["first"].alias("first"), x["chunk_index"].alias("last"), (last["size"] + x["size"]).alias("size"), F.concat(last["text"], F.lit("\n"), x["text"]).alias("text"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(joined))).otherwise(F.concat(acc, F.array(one(x)))).cast(item)

    folded = packed.select("file_path", F.explode(F.aggregate("all", F.array().cast(item), step)).alias("c"))
    return folded.select("file_path", F.col("c.first").alias("first_index"), F.col("c.last").alias("last_index"), F.col("c.size").alias("size"), F.col("c.text").alias("text"))


def without_blocked(references: DataFrame, blocklist: DataFrame) -> DataFrame:
    """References (lang, name, ...) whose name is not on the list (lang, name) of names too common to link."""
    return references.join(blocklist.select("lang", "name"), ["lang", "name"], "left_anti")


def extract_packages(manifests: DataFrame, locks: DataFrame) -> DataFrame:
    """(package, version): the packages of manifests (package, version) with the locked version where there is one."""
    return manifests.join(locks.groupBy("package").agg(F.max("version").alias("_v")), "package", "left").select("package", F.coalesce("_v", "version").alias("version"))


def newest_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert semantics of a registry: the newest row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


