"""Problem 5: the most similar vectors of every vector, by a block matrix join of int8 tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of one block of a cell; two blocks make a tile.
BLOCK = 8192
#: Rows of a tile multiplied at once.
_STRIP = 1024


def usable(vectors: DataFrame, key: str, vector: str, model: str) -> DataFrame:
    """(id, kind, v): one vector a key; kind is model and length, within which vectors are compared.

    Null, empty and all-zero vectors and those with null, NaN or infinite parts
    are left out, and rows without key or model. Of unlike rows of one key and
    kind the greatest vector counts.
    """
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    own = vectors.where(F.col(key).isNotNull() & F.col(model).isNotNull() & F.col(vector).isNotNull()).where(whole)
    kind = F.concat_ws("/", F.col(model), F.size(vector).cast("string"))
    return own.select(F.col(key).cast("string").alias("id"), kind.alias("kind"), F.col(vector).cast("array<float>").alias("v")).groupBy("id", "kind").agg(F.max("v").alias("v"))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of float32 of length 1 from a list column of one length."""
    x = column.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, error): each row is scale * codes up to a rest of euclidean length ``error``."""
    scale = np.maximum(np.abs(x).max(axis=1), np.float32(1e-30)) / np.float32(127)
    codes = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, error.astype(np.float32)


#: What float32 adds to the error of a product of two tiles, for vectors of length 1.
_ROUNDING = 1e-5


#: Products of int8 codes are whole numbers below 2**24 over this many dimensions, so float32 adds them up exactly.
_EXACT_DIMS = (1 << 24) // 127**2


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of two matrices of int8 codes.

    A product of whole numbers runs in the floating-point unit, which is many
    times faster than an integer one, in slices of dimensions whose sums it
    holds without rounding.
    """
    parts = [a[:, i : i + _EXACT_DIMS].astype(np.float32) @ b[:, i : i + _EXACT_DIMS].astype(np.float32).T for i in range(0, a.shape[1], _EXACT_DIMS)]
    return parts[0] if len(parts) == 1 else sum(p.astype(np.float64) for p in parts)


def _kth(best: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, by a partial order (what a heap of k would hold at its top)."""
    return np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k] if best.shape[1] >= k else np.full(len(best), -4.0, best.dtype)


#: Pairs of a tile for each of its rows up to which they are listed before they are ordered.
_LISTED = 32


def tile(a: tuple, b: tuple, least: float, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b) of the pairs that can be among the k best of either row in this tile with a cosine of ``least``.

    a and b are (codes, scale, error). The product of the codes gives each
    cosine up to e_a + e_b + e_a e_b. A pair is dropped only if its upper bound
    lies below ``least`` or below the k-th best lower bound of both its rows.
    Where few pairs reach ``least`` they are listed and their k-th best found
    among them; else the products are made twice, for the bounds and the pairs.
    """
    (ca, sa, ea), (cb, sb, eb) = a, b
    slack = ea.max() + eb.max() + ea.max() * eb.max() + _ROUNDING  # of the whole tile, so that bounds are one comparison

    def strips() -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(ca), _STRIP):
            near = products(ca[at : at + _STRIP], cb) * (sa[at : at + _STRIP, None] * sb[None, :])
            if same:
                near[np.arange(len(near)), at + np.arange(len(near))] = -4.0
            yield at, near

    listed, n = [], 0
    for at, near in strips():
        i, j = np.nonzero(near >= least - slack)
        n += len(i)
        if n > _LISTED * (len(ca) + len(cb)):
            break
        listed.append((i + at, j, near[i, j]))
    else:
        i, j, mid = (np.concatenate(x) for x in zip(*listed))

        def kth(ends: np.ndarray, rows: int) -> np.ndarray:
            order = np.lexsort((-mid, ends))
            whose = ends[order]
            place = np.arange(len(order)) - np.searchsorted(whose, whose)
            out = np.full(rows, -4.0, mid.dtype)
            out[whose[place == k - 1]] = mid[order][place == k - 1]
            return out

        keep = mid >= np.minimum(kth(i, len(ca))[i], kth(j, len(cb))[j]) - 2 * slack
        keep &= (i < j) | (not same)
        return i[keep], j[keep]

    tops, of_a = [], []
    for _, near in strips():
        of_a.append(_kth(near, k))
        tops.append(np.partition(near, len(near) - k, axis=0)[-k:] if len(near) > k else near)
    of_a, of_b = np.concatenate(of_a), _kth(np.concatenate(tops).T, k)
    out = []
    for at, near in strips():
        i, j = np.nonzero((near >= np.minimum(of_a[at : at + len(near), None], of_b[None, :]) - 2 * slack) & (near >= least - slack))
        i = i + at
        keep = (i < j) | (not same)
        out.append((i[keep], j[keep]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


_ROUTED = "kind string, cell int, h long, codes binary, scale float, error float"


def _route(shared, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[str, np.ndarray] = shared.value
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(2)
            names = np.array(batch.column(1).to_pylist(), object)
            for kind in sorted(set(names.tolist())):
                at = np.flatnonzero(names == kind)
                x = _unit(vectors.take(pa.array(at)))
                codes, scale, error = quantised(x)
                near = x @ pivots[kind].T
                n = min(probes, near.shape[1])
                cells = np.argpartition(near, -n, axis=1)[:, -n:].ravel() if n < near.shape[1] else np.tile(np.arange(n), len(x))
                who = pa.array(np.repeat(np.arange(len(at)), n))
                raw = codes.tobytes()
                blobs = pa.array([raw[i : i + x.shape[1]] for i in range(0, len(raw), x.shape[1])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(who)), pa.array(cells.astype(np.int32)), ids.take(pa.array(at)).take(who), blobs.take(who), pa.array(scale).take(who), pa.array(error).take(who)],
                    names=["kind", "cell", "h", "codes", "scale", "error"],
                )

    return run


def _tiles(k: int, least: float):
    """Grouped by (kind, cell, tile): the pairs of its one or two blocks that may count."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("block").to_numpy()
        ids = table.column("h").to_numpy()
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(len(side), -1)
        scale, error = table.column("scale").to_numpy(), table.column("error").to_numpy()
        blocks = np.unique(side)
        rows = [np.flatnonzero(side == b) for b in blocks]
        part = [(codes[r], scale[r], error[r]) for r in rows]
        i, j = tile(part[0], part[-1], least, k, same=len(blocks) == 1)
        a, b = ids[rows[0][i]], ids[rows[-1][j]]
        return pa.table({"t": pa.array(np.full(len(a), table.column("t")[0].as_py(), np.int64)), "a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cosines(pairs: pa.Table, rows: pa.Table) -> pa.Table:
    """Pairs (a, b) of one tile and the vectors (h, id, kind, v) they need, to (a, b, cosine) by id, from the floats.

    Where two ids share a hash, the pair stands for each of them.
    """
    rows = rows.combine_chunks()
    order = np.argsort(rows.column("h").to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    h, a, b = rows.column("h").to_numpy(), pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    i, j = np.searchsorted(h, a), np.searchsorted(h, b)
    ni, nj = np.searchsorted(h, a, side="right") - i, np.searchsorted(h, b, side="right") - j
    if (ni * nj > 1).any():
        both = [(x, y) for x0, y0, n, m in zip(i, j, ni, nj) for x in range(x0, x0 + n) for y in range(y0, y0 + m)]
        i, j = np.array(both, np.int64).reshape(-1, 2).T
    kinds = np.array(rows.column("kind").to_pylist(), object)
    same = kinds[i] == kinds[j] if len(i) else np.zeros(0, bool)
    i, j = i[same], j[same]
    vectors, ids, out = rows.column("v").combine_chunks(), rows.column("id").combine_chunks(), np.zeros(len(i))
    sizes = vectors.value_lengths().to_numpy()
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = _matrix(vectors.take(pa.array(at)))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        place = np.full(len(sizes), -1)
        place[at] = np.arange(len(at))
        k = np.flatnonzero(sizes[i] == size)
        out[k] = np.einsum("ij,ij->i", x[place[i[k]]], x[place[j[k]]])
    return pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j)), "cosine": pa.array(out)})


def _pivots(own: DataFrame, most_cells: int) -> dict[str, np.ndarray]:
    """For each kind about half as many pivots as the square root of its vectors, most_cells at most, one at least: the vectors of the smallest hashes."""
    counts = {r["kind"]: r["n"] for r in own.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # a row a kind
    most = {kind: max(1, min(most_cells, int(n**0.5 / 2))) for kind, n in counts.items()}
    if not most:
        return {}
    # a fixed share of the hash space holds twice the pivots wanted, so the sort is of that share alone
    share = F.create_map(*(F.lit(x) for kind, n in counts.items() for x in (kind, min(1.0, (2.0 * most[kind] + 64) / n))))
    h = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 40))
    few = own.select("kind", "v", "id", h.alias("h")).where(F.col("h") < share[F.col("kind")] * float(1 << 40)).orderBy("kind", "h", "id")
    by: dict[str, list] = {kind: [] for kind in most}
    for row in few.select("kind", "v").toLocalIterator():
        if len(by[row["kind"]]) < most[row["kind"]]:
            by[row["kind"]].append(row["v"])
    for kind, rows in by.items():
        if not rows:  # never at the sizes that have more than one cell, but one pivot there must be
            rows.append(own.where(F.col("kind") == kind).select("v").first()["v"])
    return {kind: _unit(pa.array(rows, pa.list_(pa.float32()))) for kind, rows in by.items()}


def _h(*columns: str) -> F.Column:
    return F.xxhash64(*columns)


def similar_vectors(vectors: DataFrame, key: str, vector: str, model: str, k: int = 5, least: float = -1.0, probes: int = 8, most_cells: int = 4096, block: int = BLOCK) -> DataFrame:
    """For every vector its k most similar others of the same model and length, of cosine ``least`` or more.

    Returns id, other, cosine, position (1 is most similar; ties by id). Every
    vector is searched for and searched. Each goes into the cells of its
    ``probes`` nearest pivots; pivots are a sample of the vectors, half the
    square root of their number, ``most_cells`` at most, and are all that is
    broadcast.
    The vectors of a cell are compared in tiles of two blocks, by products of
    int8 codes with error bounds; pairs that may still be among the k best are
    recomputed in float and merged. Two vectors meet if they share a cell; in a
    cell nothing is lost, so with ``most_cells=1`` the result is exact, at a
    cost that grows with the square of the vectors. Pairs of a low cosine share
    a cell more seldom: README gives the recall by cosine. Four probes are
    enough where ``least`` is 0.8.

    Equal vectors are collapsed before: of a group of equal vectors the k + 1
    smallest ids are compared with the others, the rest have the k smallest
    ids of the group as their neighbours. So copies of a vector cost nothing.
    A crowded cell is cut into blocks, each pair of blocks a task.

    Vectors that cannot be compared (see usable) have no rows and are in none;
    an empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = usable(vectors, key, vector, model)
    marked = own.select("id", "kind", F.xxhash64("kind", "v").alias("same"))
    # the k + 1 smallest ids of each group of equal vectors, salted so that a large group is no single task
    salted = W.partitionBy("same", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    narrow = marked.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    crowd = narrow.groupBy("same").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")).where(F.size("ids") > k)
    passive = marked.join(crowd, "same").where(~F.array_contains("ids", F.col("id")))
    tied = passive.select("id", F.explode(F.slice("ids", 1, k)).alias("other"), F.lit(1.0).alias("cosine"))
    active = own.join(passive.select("id", "kind"), ["id", "kind"], "left_anti")

    shared = spark.sparkContext.broadcast(_pivots(own, most_cells))
    # in the tiles a vector goes by the hash of its id: where two ids share one, both are looked at afterwards
    routed = active.select(_h("id", "kind").alias("h"), "kind", "v").mapInArrow(_route(shared, probes), _ROUTED)
    sizes = routed.groupBy("kind", "cell").agg(F.count("*").alias("c"))
    # most_cells rows a kind; cells are cut into blocks by a hash of the id, and a row goes to every tile of its block
    cut = routed.join(F.broadcast(sizes), ["kind", "cell"]).withColumn("m", F.ceil(F.col("c") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("h", F.lit(3)), F.col("m")).cast("int"))
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("p"), F.greatest(o, F.col("block")).alias("q"))))
    met = cut.select(tiles.alias("t"), "kind", "cell", "block", "h", "codes", "scale", "error").select(F.xxhash64("kind", "cell", "t.p", "t.q").alias("t"), "block", "h", "codes", "scale", "error")
    found = met.groupBy("t").applyInArrow(_tiles(k, least), "t long, a long, b long")
    # each pair is computed in one of its tiles, so a vector travels once for each tile that needs it and not for each pair
    pairs = found.groupBy("a", "b").agg(F.min("t").alias("t"))
    need = pairs.select("t", F.explode(F.array("a", "b")).alias("h")).distinct()
    names = own.select("id", "kind", _h("id", "kind").alias("h"))
    floats = need.join(names, "h").join(own, ["id", "kind"]).select(F.col("t").alias("u"), "h", "id", "kind", "v")
    exact = pairs.groupBy("t").cogroup(floats.groupBy("u")).applyInArrow(_cosines, "a string, b string, cosine double").where(F.col("cosine") >= least)
    ends = exact.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "cosine").select("e.id", "e.other", "cosine")
    order = W.partitionBy("id").orderBy(F.round("cosine", 9).desc(), "other")  # few rows an id: k from each of its tiles
    return ends.unionByName(tied).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
