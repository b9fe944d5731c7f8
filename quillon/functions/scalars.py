"""Column expressions that the operators share; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of memory, lower-case.
MEMORY_TYPES = ("decision", "pattern", "preference", "style", "habit", "insight", "context")


def ts(text: str) -> Column:
    """A timestamp without zone."""
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def when_of(now: str | Column) -> Column:
    return ts(now) if isinstance(now, str) else now


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def hours_since(then: Column, now: Column) -> Column:
    """Whole hours, 0 for the future."""
    return F.greatest(F.lit(0), F.timestamp_diff("HOUR", then, now))


def days_since(then: Column, now: Column) -> Column:
    """Days with fraction, from whole seconds."""
    return F.timestamp_diff("SECOND", then, now) / F.lit(86400.0)


def not_expired(now: Column, column: str = "expires_at") -> Column:
    return F.col(column).isNull() | (F.col(column) > now)


def valid_at(when: Column, prefix: str = "") -> Column:
    """valid_from <= when < valid_to, null being unbounded."""
    lo, hi = F.col(prefix + "valid_from"), F.col(prefix + "valid_to")
    return (lo.isNull() | (lo <= when)) & (hi.isNull() | (hi > when))


def edge_active(when: Column, prefix: str = "") -> Column:
    """Of edges: valid_from <= when <= valid_to, null being unbounded. Unlike a node, an edge still counts at the moment in which it ends."""
    lo, hi = F.col(prefix + "valid_from"), F.col(prefix + "valid_to")
    return (lo.isNull() | (lo <= when)) & (hi.isNull() | (hi >= when))


def json_text(column: str, path: str) -> Column:
    """A scalar out of a JSON text; null where the text is no JSON."""
    return F.get_json_object(column, path)


def memory_type(column: str = "memory_type") -> Column:
    """The kind, whatever its letter case; null if unknown."""
    low = F.lower(F.trim(column))
    return F.when(low.isin(*MEMORY_TYPES), low)


def sha256(column: str) -> Column:
    return F.sha2(F.col(column), 256)


def non_whitespace(column: str) -> Column:
    return F.length(F.regexp_replace(column, r"(?U)\s", ""))


def id_kind(column: str) -> Column:
    """What a node id names: the prefix before the colon, else memory."""
    prefix = F.regexp_extract(column, r"^(sym|file|pkg|chunk|doc|ext|commit|pr|dir):", 1)
    return F.when(prefix == "", "memory").otherwise(prefix)


def path_of(column: str) -> Column:
    """A node id without its prefix."""
    return F.regexp_replace(column, r"^(sym|file|pkg|chunk|doc|ext|commit|pr|dir):", "")


def module_of(path: Column) -> Column:
    """First segment of a path."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def directory_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def path_tags(path: Column) -> Column:
    """ext:, dir: and file: tags of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return F.filter(
        F.array(F.when(ext != "", F.concat(F.lit("ext:"), ext)), F.when(parent != "", F.concat(F.lit("dir:"), parent)), F.when(name != "", F.concat(F.lit("file:"), name))),
        lambda x: x.isNotNull(),
    )


def relative_path(path: Column, cwd: Column) -> Column:
    base = F.concat(F.rtrim(cwd, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def edge_id(src: str, relationship: Column, dst: str) -> Column:
    return F.concat_ws("-", F.col(src), relationship, F.col(dst))


def expires_at(created: Column, ttl_hours: Column) -> Column:
    return F.timestamp_add("HOUR", ttl_hours, created)


def first_chars(column: str, n: int) -> Column:
    return F.left(F.col(column), F.lit(n))


def signature(column: str | Column, most: int = 120) -> Column:
    """The first line, cut at the last blank within ``most`` characters."""
    line = F.split_part(F.col(column) if isinstance(column, str) else column, F.lit("\n"), F.lit(1))
    head = F.left(line, F.lit(most))
    cut = F.regexp_extract(head, r"^(.*)\s\S*$", 1)
    return F.when(F.length(line) <= most, line).when(cut != "", cut).otherwise(head)


def log_confidence(n: Column, sessions: Column) -> Column:
    """ln(n) / ln(sessions), at most 1 and 0 where either is below 2."""
    return F.when((n < 1) | (sessions < 1), 0.0).otherwise(F.least(F.lit(1.0), F.log(n.cast("double")) / F.greatest(F.log(sessions.cast("double")), F.lit(1.0))))


def nearest_rank(ordered: Column, q: float) -> Column:
    """Element round(q (n - 1)) of a sorted array."""
    return F.element_at(ordered, F.round(F.lit(q) * (F.size(ordered) - 1)).cast("int") + 1)
