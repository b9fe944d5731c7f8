"""Code-health analyses over the graph, the activity and the text of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S
from .review import TEST_FILE

#: Names and contents that matter for security.
SENSITIVE = r"(?i)(auth|secret|key|password|token|credential|\.env|private|encrypt|decrypt|cert|permission|rbac|oauth|jwt|session|cookie|csrf|xss|injection|sanitize)"
SECURITY_CALL = r"(?i)(hash|verify|sign|encrypt|authenticate|authorize|validate_token|check_permission)"
CREDENTIAL = r"""(?i)(password|secret|api_key|apikey|token|private_key)\s*[:=]\s*["'][^"']{8,}["']"""
SQL_CONCAT = r"""(?i)(SELECT|INSERT|UPDATE|DELETE|DROP)\s+.*\+\s*[a-zA-Z_]|format!\s*\(\s*"[^"]*(?:SELECT|INSERT|UPDATE|DELETE)"""
UNSAFE = r"unsafe\s*\{"

#: Kinds of symbols that should have documentation.
DOCUMENTED = ("function", "method", "class", "interface", "type")

SYMBOLS = ("function", "method", "class", "struct", "trait", "interface")


def co_change_pairs(commits: DataFrame, least: int = 2, most_files: int = 50) -> DataFrame:
    """(a, b, n, weight): files changed together in at least ``least`` commits; weight is n over all commits.

    Commits of more than ``most_files`` files say nothing about pairs and are
    left out: that is the rule of the measure, and it bounds the pairs of one
    commit. commits (hash, files).
    """
    total = commits.agg(F.count("*").alias("all"))  # one row
    files = F.array_sort(F.array_distinct("files"))
    own = commits.select("hash", files.alias("f")).where(F.size("f").between(2, most_files))
    pairs = own.select(F.posexplode("f").alias("i", "a"), "f").select("a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).crossJoin(F.broadcast(total)).select("a", "b", "n", (F.col("n") / F.col("all")).alias("weight"))


def file_stats(commits: DataFrame, days: int = 90) -> DataFrame:
    """(file, commits, authors, churn): churn is commits a month of the period."""
    each = commits.select("hash", "author", F.explode(F.array_distinct("files")).alias("file"))
    return each.groupBy("file").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors")).withColumn("churn", F.col("commits") / (days / 30.0))


def ownership(commits: DataFrame) -> DataFrame:
    """(file, owner, owned, contributors, crowded): the author of most commits (ties by name); crowded above 5 contributors."""
    n = commits.select("author", F.explode(F.array_distinct("files")).alias("file")).groupBy("file", "author").agg(F.count("*").alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("c"), "author")).alias("m")
    return n.groupBy("file").agg(best, F.count("*").alias("contributors")).select("file", F.col("m.author").alias("owner"), (-F.col("m.c")).alias("owned"), "contributors", (F.col("contributors") > 5).alias("crowded"))


def api_surface(nodes: DataFrame) -> DataFrame:
    """(file_path, public, private, share) of the symbols of each file."""
    own = nodes.where(F.col("kind").isin(*SYMBOLS)).select("id", S.json_text("payload", "$.file_path").alias("file_path"), (S.json_text("payload", "$.visibility") == "public").alias("p")).distinct()
    known = own.where("file_path IS NOT NULL").groupBy("file_path").agg(F.count_if(F.coalesce("p", F.lit(False))).alias("public"), F.count("*").alias("all"))
    return known.select("file_path", "public", (F.col("all") - F.col("public")).alias("private"), (F.col("public") / F.col("all")).alias("share"))


def doc_coverage(nodes: DataFrame, below: float | None = None) -> DataFrame:
    """(file_path, documented, symbols, share): of the public symbols of a file, those whose payload has a doc_comment that is not blank."""
    doc = F.coalesce(F.trim(S.json_text("payload", "$.doc_comment")) != "", F.lit(False))
    own = nodes.where(F.col("kind").isin(*DOCUMENTED) & (S.json_text("payload", "$.visibility") == "public"))
    sym = own.select("id", S.json_text("payload", "$.file_path").alias("file_path"), doc.alias("d")).distinct().where("file_path IS NOT NULL")
    out = sym.groupBy("file_path").agg(F.count_if("d").alias("documented"), F.count("*").alias("symbols")).withColumn("share", F.col("documented") / F.col("symbols"))
    return out.where(F.col("share") < below) if below is not None else out


def security_names(nodes: DataFrame) -> DataFrame:
    """(id, flag): files and endpoints with a sensitive name, functions that do something about security."""
    label = F.coalesce("label", S.path_of("id"))
    flag = F.when(F.col("kind").isin("file", "endpoint") & label.rlike(SENSITIVE), F.concat(F.lit("sensitive_"), F.col("kind"))).when(F.col("kind").isin("function", "method") & label.rlike(SECURITY_CALL), "security_function")
    return nodes.select("id", flag.alias("flag")).where("flag IS NOT NULL").distinct()


def security_scan(chunks: DataFrame) -> DataFrame:
    """(id, credentials, sql_concat, unsafe_blocks) of chunks in which one of them is found; whole texts are searched."""
    return chunks.select("id", F.col("text").rlike(CREDENTIAL).alias("credentials"), F.col("text").rlike(SQL_CONCAT).alias("sql_concat"), F.regexp_count("text", F.lit(UNSAFE)).alias("unsafe_blocks")).where("credentials OR sql_concat OR unsafe_blocks > 0")


def coupling(edges: DataFrame, above: int = 15) -> DataFrame:
    """(id, degree): nodes with more than ``above`` ends of edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")).where(F.col("degree") > above)


def symbols_per_file(nodes: DataFrame) -> DataFrame:
    path = S.json_text("payload", "$.file_path")
    return nodes.where(F.col("kind").isin(*SYMBOLS)).groupBy(path.alias("file_path")).agg(F.countDistinct("id").alias("symbols")).where("file_path IS NOT NULL")


#: A line that decides something.
DECIDES = r"^\s*(?:\}?\s*else\s+)?(?:if|elif|for|while|match|case|switch|catch|except|loop)\b"


def complexity(chunks: DataFrame) -> DataFrame:
    """(id, cyclomatic, depth, lines): 1 + lines that decide + && and ||; deepest nesting of braces (of indents where there are none)."""
    lines = F.split("text", r"\r\n|\r|\n", -1)
    braces = F.filter(F.split(F.regexp_replace("text", r"[^{}]", ""), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = F.when(c == "{", acc["now"] + 1).otherwise(F.greatest(F.lit(0), acc["now"] - 1))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    nested = F.aggregate(braces, start, step, lambda acc: acc["most"])
    indent = F.array_max(F.transform("l", lambda x: (F.length(F.regexp_extract(x, "^ *", 0)) / 4).cast("int") + F.length(F.regexp_extract(x, "^\t*", 0))))
    own = chunks.where("text IS NOT NULL").select("id", "text", lines.alias("l"), nested.alias("n"))
    count = F.lit(1) + F.size(F.filter("l", lambda x: x.rlike(DECIDES))) + F.regexp_count("text", F.lit("&&")) + F.regexp_count("text", F.lit(r"\|\|"))
    return own.select("id", count.alias("cyclomatic"), F.when(F.col("n") > 0, F.col("n")).otherwise(indent).alias("depth"), F.size("l").alias("lines"))


def code_smells(chunks: DataFrame, top: int = 50) -> DataFrame:
    """(subject, smell, size, severity): long functions, many parameters, deep nesting, long files; the ``top`` worst, by severity and size."""
    m = chunks.select("id", "file_path", "line_end", "line_start", F.regexp_extract("text", r"^[^(\n]*\(([^)]*)\)", 1).alias("args"), "node_kind")
    fn = m.where(F.col("node_kind").isin("function_item", "method", "function"))
    length = F.col("line_end") - F.col("line_start") + 1
    long = fn.where(length > 50).select(F.col("id").alias("subject"), F.lit("long_function").alias("smell"), length.cast("long").alias("size"), F.when(length > 100, "high").otherwise("medium").alias("severity"))
    params = F.when(F.trim("args") == "", 0).otherwise(F.size(F.split("args", ",")))
    many = fn.where(params > 5).select("id", F.lit("many_parameters"), params.cast("long"), F.when(params > 8, "high").otherwise("medium"))
    deep = complexity(chunks).where("depth > 4").select("id", F.lit("deep_nesting"), F.col("depth").cast("long"), F.when(F.col("depth") > 6, "high").otherwise("medium"))
    files = chunks.groupBy("file_path").agg(F.max("line_end").alias("n")).where("n > 500").select("file_path", F.lit("long_file"), F.col("n").cast("long"), F.when(F.col("n") > 1000, "high").otherwise("medium"))
    every = long.union(many).union(deep).union(files)
    return every.orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), F.col("size").desc(), "subject", "smell").limit(top)


def hot_complex(activity: DataFrame, chunks: DataFrame, top: int = 20) -> DataFrame:
    """(file_path, edits, cyclomatic, heat): files that are changed often and are complex; heat is the product."""
    edits = activity.where(F.col("tool_name").isin("Edit", "Write") & F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count("*").alias("edits"))
    worst = complexity(chunks).join(chunks.select("id", "file_path"), "id").groupBy("file_path").agg(F.max("cyclomatic").alias("cyclomatic"))
    return edits.join(worst, "file_path").withColumn("heat", F.col("edits") * F.col("cyclomatic")).orderBy(F.col("heat").desc(), "file_path").limit(top)


def architecture(edges: DataFrame, relationships: tuple[str, ...] = ("IMPORTS", "DEPENDS_ON", "CALLS")) -> DataFrame:
    """(module, role): top (depends, not depended on), bottom (the reverse) or cycle (two modules depend on each other)."""
    module = lambda c: S.directory_of(F.regexp_replace(S.path_of(c), r":\d+$", ""))
    dep = edges.where(F.col("relationship").isin(*relationships) & F.startswith("src", F.lit("file:")) & F.startswith("dst", F.lit("file:"))).select(module("src").alias("a"), module("dst").alias("b")).where("a <> b").distinct()
    a, b = dep.select(F.col("a").alias("module")).distinct(), dep.select(F.col("b").alias("module")).distinct()
    mutual = dep.join(dep.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).select(F.col("a").alias("module")).distinct()
    return a.join(b, "module", "left_anti").withColumn("role", F.lit("top")).union(b.join(a, "module", "left_anti").withColumn("role", F.lit("bottom"))).union(mutual.withColumn("role", F.lit("cycle")))


def test_mapping(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(test, symbol, how): by name (test_x and x) or by a call from the test."""
    path = S.json_text("payload", "$.file_path")
    own = nodes.where(F.col("kind").isin("function", "method", "test")).select("id", "kind", F.lower(F.coalesce("label", S.path_of("id"))).alias("name"), path.alias("p")).distinct()
    is_test = F.coalesce((F.col("kind") == "test") | F.col("name").rlike(r"^test_|_test$") | F.col("p").rlike(TEST_FILE), F.lit(False))
    tests, code = own.where(is_test).withColumn("stem", F.regexp_replace("name", r"^test_|_test$", "")), own.where(~is_test)
    by_name = tests.select(F.col("id").alias("test"), "stem").join(code.select(F.col("id").alias("symbol"), F.col("name").alias("stem")), "stem").select("test", "symbol", F.lit("name").alias("how"))
    calls = edges.where("relationship = 'CALLS'").select(F.col("src").alias("test"), F.col("dst").alias("symbol")).distinct()
    by_call = calls.join(tests.select(F.col("id").alias("test")), "test", "left_semi").join(code.select(F.col("id").alias("symbol")), "symbol", "left_semi").select("test", "symbol", F.lit("call"))
    return by_name.union(by_call).distinct()


def untested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, symbols): public functions of a file that no test names or calls."""
    public = nodes.where(F.col("kind").isin("function", "method") & (S.json_text("payload", "$.visibility") == "public")).select("id", S.json_text("payload", "$.file_path").alias("file_path")).distinct()
    covered = test_mapping(nodes, edges).select(F.col("symbol").alias("id")).distinct()
    return public.join(covered, "id", "left_anti").groupBy("file_path").agg(F.count("*").alias("symbols"))


def reassessed(memories: DataFrame) -> DataFrame:
    """(id, importance): where the tags ask for another importance by more than 0.01: critical at least 0.8, signal in [0.5, 0.7], noise at most 0.3."""
    has = lambda t: F.coalesce(F.array_contains("tags", t), F.lit(False))
    i = F.coalesce("importance", F.lit(0.5))
    new = F.when(has("critical"), F.greatest(i, F.lit(0.8))).when(has("signal"), S.clamp(i, 0.5, 0.7)).when(has("noise"), F.least(i, F.lit(0.3))).otherwise(i)
    return memories.select("id", new.alias("importance"), i.alias("was")).where(F.abs(F.col("importance") - F.col("was")) > 0.01).drop("was")


def change_impact(edges: DataFrame) -> DataFrame:
    """(id, callers, callees, co_changed, importance): importance is their number over 20 within [0.4, 0.9]."""
    calls = edges.where("relationship = 'CALLS'").select("src", "dst").distinct()
    co = edges.where("relationship = 'CO_CHANGED'").select("src", "dst")
    one = lambda df, by, name: df.groupBy(F.col(by).alias("id")).agg(F.count("*").alias(name))
    joined = one(calls, "dst", "callers").join(one(calls, "src", "callees"), "id", "full").join(one(co.union(co.select("dst", "src")).distinct(), "src", "co_changed"), "id", "full").fillna(0)
    return joined.withColumn("importance", S.clamp((F.col("callers") + F.col("callees") + F.col("co_changed")) / 20.0, 0.4, 0.9))


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("function", "method"), exempt: Column | None = None, least: int = 10) -> DataFrame:
    """(id, file_path): symbols that nothing calls, imports, inherits or implements; none if there are fewer than ``least`` symbols."""
    path = S.json_text("payload", "$.file_path")
    own = nodes.where(F.col("kind").isin(*kinds)).select("id", "label", path.alias("file_path")).distinct()
    spared = F.coalesce(F.lower("label").rlike(r"^(main|new|test_.*|.*_test)$"), F.lit(False)) if exempt is None else exempt
    used = edges.where(F.col("relationship").isin("CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS")).select(F.col("dst").alias("id")).distinct()
    size = own.agg((F.count("*") >= least).alias("enough"))  # one row
    return own.where(~spared).join(used, "id", "left_anti").crossJoin(F.broadcast(size)).where("enough").select("id", "file_path")


def activity_insights(memories: DataFrame, nodes: DataFrame) -> DataFrame:
    """(what, n) of a dashboard: memories by health tag, nodes with security flags."""
    tags = memories.select(F.explode(F.array_distinct("tags")).alias("t")).where(F.col("t").isin("static-analysis", "security", "perf", "refactor", "bug")).groupBy("t").agg(F.count("*").alias("n"))
    flags = security_names(nodes).groupBy("flag").agg(F.count("*").alias("n"))
    return tags.select(F.concat(F.lit("tag:"), "t").alias("what"), "n").union(flags.select(F.concat(F.lit("flag:"), "flag"), "n"))


def per_file_top(scored: DataFrame, file: str, score: str, key: str, floor: float, least: int, share: DataFrame | None = None) -> DataFrame:
    """The best rows of each file with a score of ``floor`` or more: ``least``, or share (file, keep) of them where given. The cut is the feature."""
    order = W.partitionBy(file).orderBy(F.col(score).desc(), key)
    ranked = scored.where(F.col(score) >= floor).withColumn("r", F.row_number().over(order))
    kept = ranked.join(share, file, "left").withColumn("keep", F.greatest(F.lit(least), F.coalesce("keep", F.lit(least)))) if share is not None else ranked.withColumn("keep", F.lit(least))
    return kept.where("r <= keep").drop("r", "keep")


#: Weights of the score by which chunks are kept: degree, parent symbol, link with a memory, size; the second row where there are no memories.
CHUNK_WEIGHTS = {True: (0.3, 0.2, 0.3, 0.2), False: (0.4, 0.3, 0.0, 0.3)}
_CODE_ENDS = r"^(sym|file|chunk|pkg|contains|ref):"


def compacted_chunks(chunks: DataFrame, edges: DataFrame, symbols: DataFrame, with_memories: bool = True, most: int = 10, floor: float = 0.2) -> DataFrame:
    """(id, file_path, score) of the chunks that are kept of each file.

    chunks (id, file_path, parent_symbol, size), symbols (id, file_path). The
    score adds up the chunk's edges and its size, both against the greatest
    there is, whether it has a parent symbol and whether an edge leads to a
    memory. Kept are chunks of a score of ``floor``, the best min(most, chunks)
    of a file, but max(3, symbols of the file) at least. Chunks without a file
    are left out; ties by id. The cut is the feature.
    """
    own = chunks.where("id IS NOT NULL AND file_path IS NOT NULL").groupBy("id").agg(F.min(F.struct("file_path", "parent_symbol", "size")).alias("m")).select("id", "m.*")
    ends = edges.select(F.col("id").alias("e"), F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), F.array("src", "dst").alias("both"))
    met = ends.select("id", F.coalesce(F.element_at(F.array_remove("both", F.col("id")), 1), F.col("id")).alias("other"))
    degree = met.join(own.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"), F.max((~F.col("other").rlike(_CODE_ENDS)).cast("int")).alias("linked"))
    joined = own.join(degree, "id", "left").fillna(0, ["degree", "linked", "size"])
    top = joined.agg(F.greatest(F.lit(1), F.max("degree")).alias("d"), F.greatest(F.lit(1), F.max("size")).alias("s"))  # one row
    w = CHUNK_WEIGHTS[with_memories]
    score = w[0] * F.col("degree") / F.col("d") + w[1] * F.col("parent_symbol").isNotNull().cast("int") + w[2] * F.col("linked") + w[3] * F.col("size") / F.col("s")
    scored = joined.crossJoin(F.broadcast(top)).select("id", "file_path", F.round(score, 9).alias("score"))
    counts = scored.groupBy("file_path").agg(F.count("*").alias("n")).join(symbols.where("file_path IS NOT NULL").distinct().groupBy("file_path").agg(F.count("*").alias("y")), "file_path", "left")
    keep = counts.select("file_path", F.greatest(F.least(F.lit(most), F.col("n")), F.lit(3), F.coalesce("y", F.lit(0))).cast("int").alias("keep"))
    order = W.partitionBy("file_path").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("r", F.row_number().over(order)).join(keep, "file_path").where((F.col("r") <= F.col("keep")) & (F.col("score") >= floor)).select("id", "file_path", "score")
