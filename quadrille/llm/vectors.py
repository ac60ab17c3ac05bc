"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors are first folded into one representative with a count. Each
representative is turned into PCA axes (variance falls along the axes), laid out
by the signs of a few axes and then along the first one, and packed into tiles
of ``TILE`` vectors. Two tiles are compared unless their boxes on the leading
axes lie further apart than the threshold allows. Inside a pair of tiles the dot
products of the leading axes come first; what the rest can add is at most the
product of the suffix norms, so rows, columns and at last single pairs whose
bound falls below the threshold are dropped before later axes are read. Pairs
near the threshold are settled in double precision on the original components.

A pair of tiles returns counts of links per vector and a spanning forest of its
links, never the links themselves, so a dense group costs no more output than a
sparse one. The work grows with the square of the number of distinct vectors
that the boxes cannot tell apart; the README gives figures.

Results for odd input: a vector that is null, empty, zero or holds null or
non-finite components links with nothing and is its own component; vectors of
unlike lengths never link; equal vectors (and repeated rows) link with each
other; a null id stays null and counts as a linked vector, its component is the
smallest id reachable (null if there is none); an empty table gives an empty
table. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.components import connected_components
from quadrille.operators.skew import spread_join
from quadrille.storage import materialize, n_partitions

THRESHOLD = 0.95
TILE = 4096
#: Leading axes whose ranges a tile keeps.
BOX = 8
#: Axes 2 to 1 + STRATA, whose signs group vectors before they are laid out along the first.
STRATA = 4
#: The axes come from at most about this many vectors and numbers; they decide speed, never results.
FIT_ROWS = 8192
FIT_NUMBERS = 1 << 21
#: Single precision decides pairs further than this from the threshold.
MARGIN = 1e-4
_ROWS = 512


def usable(v: Column) -> Column:
    """True for vectors that can have a cosine."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    m = matrix.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def principal_axes(rows: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose columns are the axes by falling variance of the unit vectors."""
    u = units(rows)
    _, axes = np.linalg.eigh(u.T @ u)
    return axes[:, ::-1].copy()


def fit_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """Axes for each length of vector, from a bounded sample drawn by hash."""
    axes = {}
    for r in reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(16).collect():
        dim, n = r["dim"], r["count"]
        most = max(dim, min(FIT_ROWS, FIT_NUMBERS // dim))
        rows = reps.where(F.col("dim") == dim)
        if n > most:
            draw = F.xxhash64(F.lit("axes"), F.col("v")).bitwiseAND(F.lit((1 << 30) - 1))
            rows = rows.where(draw < int((1 << 30) * most / n))
        if dim <= 4096:
            sample = rows.select("v").toArrow().column("v").combine_chunks()
            if len(sample):
                axes[dim] = principal_axes(_matrix(sample))
    return axes


_TURNED = "rep long, copies long, dim int, stratum int, first double, turned binary, raw binary"
_TILES = "tile long, dim int, n int, wide boolean, lo array<double>, hi array<double>, reps binary, copies binary, turned binary, raw binary"


def _turn(reps: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """Rows with their coordinates on the axes; lengths without fitted axes keep their own."""
    wide = dict(reps.dtypes)["v"] == "array<double>"
    sent = reps.sparkSession.sparkContext.broadcast(axes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim in sorted(set(batch.column("dim").to_pylist())):
                part = table.filter(pa.compute.equal(table["dim"], dim)).combine_chunks()
                raw = _matrix(part["v"].combine_chunks())
                turned = units(raw)
                if dim in sent.value:
                    turned = turned @ sent.value[dim]
                signs = turned[:, 1 : 1 + STRATA] > 0
                stratum = signs @ (1 << np.arange(signs.shape[1])) if signs.shape[1] else np.zeros(len(raw))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["rep"].combine_chunks(),
                        part["copies"].combine_chunks(),
                        pa.array(np.full(len(raw), dim, np.int32)),
                        pa.array(stratum.astype(np.int32)),
                        pa.array(turned[:, 0]),
                        pa.array([x.tobytes() for x in turned.astype("<f4")], pa.binary()),
                        pa.array([x.tobytes() for x in raw.astype("<f8" if wide else "<f4")], pa.binary()),
                    ],
                    ["rep", "copies", "dim", "stratum", "first", "turned", "raw"],
                )

    return reps.select("rep", "copies", "dim", "v").mapInArrow(work, _TURNED)


def _pack(turned: DataFrame, wide: bool, tile: int) -> DataFrame:
    """Tiles of up to ``tile`` neighbours, cut where the length or the stratum changes."""

    def one(number: int, rows: dict) -> pa.RecordBatch:
        dim = rows["dim"]
        box = np.frombuffer(b"".join(rows["turned"]), "<f4").reshape(-1, dim)[:, :BOX].astype(np.float64)
        values = {
            "tile": [number],
            "dim": pa.array([dim], pa.int32()),
            "n": pa.array([len(rows["rep"])], pa.int32()),
            "wide": [wide],
            "lo": [(box.min(0) - 1e-6).tolist()],
            "hi": [(box.max(0) + 1e-6).tolist()],
            "reps": [np.array(rows["rep"], "<i8").tobytes()],
            "copies": [np.array(rows["copies"], "<i8").tobytes()],
            "turned": [b"".join(rows["turned"])],
            "raw": [b"".join(rows["raw"])],
        }
        return pa.RecordBatch.from_pydict(values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key, rows = TaskContext.get().partitionId() << 32, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["dim"], r["stratum"]) or len(rows["rep"]) == tile:
                    if rows:
                        yield one(number, rows)
                        number += 1
                    key, rows = (r["dim"], r["stratum"]), {"dim": r["dim"], "rep": [], "copies": [], "turned": [], "raw": []}
                for k in ("rep", "copies", "turned", "raw"):
                    rows[k].append(r[k])
        if rows:
            yield one(number, rows)

    return turned.mapInArrow(work, _TILES)


class Forest:
    """Union-find over representatives; says which links join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(x, x)) != top:
            up[x], x = top, above
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Places of links that connect what all links (i, j) between nodes 0..n-1 connect; a few for each node."""
    label, left, picked = np.arange(n), np.arange(len(i)), []
    while True:
        a, b = label[i[left]], label[j[left]]
        live = a != b
        if not live.any():
            return np.unique(np.concatenate(picked)) if picked else left[:0]
        left, a, b = left[live], a[live], b[live]
        best = np.full(n, -1)
        best[a], best[b] = left, left
        chosen = np.unique(best[best >= 0])
        picked.append(chosen)
        forest = Forest()
        for x, y in zip(label[i[chosen]].tolist(), label[j[chosen]].tolist(), strict=True):
            forest.join(x, y)
        roots = np.arange(n)
        for x in forest.up:
            roots[x] = forest.root(x)
        label = roots[label]


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, exact) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the pairs of a and b, unit rows on PCA axes, with cosine >= threshold.

    ``exact(i, j)`` gives cosines in double precision for pairs too near the
    threshold for single precision.
    """
    dim = a.shape[1]
    stops = [k for k in (8, 16, 32, 64, 128, 256, 512) if k < dim] + [dim]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    part = np.zeros((len(a), len(b)), np.float32)
    start = 0
    low = threshold - MARGIN
    for stop in stops:
        part += a[rows, start:stop] @ b[cols, start:stop].T
        start = stop
        if stop == dim:
            break
        ra, rb = np.linalg.norm(a[rows, stop:], axis=1), np.linalg.norm(b[cols, stop:], axis=1)
        live = part + np.outer(ra, rb) >= low
        n_live = int(np.count_nonzero(live))
        if not n_live:
            return rows[:0], cols[:0]
        if n_live * 4 < part.size // 16:  # so few that pairs are cheaper than the matrix
            i, j = np.nonzero(live)
            s = part[i, j]
            for lo in range(0, len(i), 1 << 16):
                cut = slice(lo, lo + (1 << 16))
                s[cut] += np.einsum("ij,ij->i", a[rows[i[cut]], stop:], b[cols[j[cut]], stop:])
            return _settle(rows[i], cols[j], s, threshold, exact)
        keep_r, keep_c = live.any(1), live.any(0)
        if not (keep_r.all() and keep_c.all()):
            rows, cols, part = rows[keep_r], cols[keep_c], part[np.ix_(keep_r, keep_c)]
    i, j = np.nonzero(part >= low)
    return _settle(rows[i], cols[j], part[i, j], threshold, exact)


def _settle(i: np.ndarray, j: np.ndarray, s: np.ndarray, threshold: float, exact) -> tuple[np.ndarray, np.ndarray]:
    sure = s >= threshold + MARGIN
    near = np.flatnonzero(~sure & (s >= threshold - MARGIN))
    for lo in range(0, len(near), 1 << 16):
        cut = near[lo : lo + (1 << 16)]
        sure[cut] = exact(i[cut], j[cut]) >= threshold
    return i[sure], j[sure]


class Tile:
    def __init__(self, row: dict, side: str):
        dim = row["dim"]
        self.number = row[f"{side}_tile"]
        self.reps = np.frombuffer(row[f"{side}_reps"], "<i8")
        self.copies = np.frombuffer(row[f"{side}_copies"], "<i8")
        self.turned = np.frombuffer(row[f"{side}_turned"], "<f4").reshape(-1, dim)
        self.raw = np.frombuffer(row[f"{side}_raw"], "<f8" if row["wide"] else "<f4").reshape(-1, dim)


def _exact(a: Tile, b: Tile):
    def cosines(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = a.raw[i].astype(np.float64), b.raw[j].astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        y /= np.abs(y).max(axis=1, keepdims=True)
        return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))

    return cosines


def _compare(pairs: DataFrame, threshold: float) -> DataFrame:
    """Rows (rep, links, other): links counted for rep, or, with other set, a link of the spanning forest."""

    def one(row: dict, forest: Forest) -> pa.RecordBatch:
        a, b = Tile(row, "a"), Tile(row, "b")
        same = a.number == b.number
        count_a, count_b = np.zeros(len(a.reps), np.int64), np.zeros(len(b.reps), np.int64)
        edges = []
        cosines = _exact(a, b)
        for lo in range(0, len(a.reps), _ROWS):
            first = lo if same else 0
            i, j = close_pairs(
                a.turned[lo : lo + _ROWS], b.turned[first:], threshold, lambda i, j, lo=lo, first=first: cosines(i + lo, j + first)
            )
            i, j = i + lo, j + first
            if same:
                once = i < j
                i, j = i[once], j[once]
            if not len(i):
                continue
            count_a += np.bincount(i, b.copies[j], len(count_a)).astype(np.int64)
            count_b += np.bincount(j, a.copies[i], len(count_b)).astype(np.int64)
            nodes, at = np.unique(np.concatenate([a.reps[i], b.reps[j]]), return_inverse=True)
            tree = spanning(at[: len(i)], at[len(i) :], len(nodes))
            edges += [e for e in zip(a.reps[i[tree]].tolist(), b.reps[j[tree]].tolist(), strict=True) if forest.join(*e)]
        rep, links = np.concatenate([a.reps, b.reps]), np.concatenate([count_a, count_b])
        rep, links = rep[links > 0], links[links > 0]
        src = pa.array([x for x, _ in edges], pa.int64())
        dst = pa.array([x for _, x in edges], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(rep), src]),
                pa.concat_arrays([pa.array(links), pa.array(np.zeros(len(edges), np.int64))]),
                pa.concat_arrays([pa.nulls(len(rep), pa.int64()), dst]),
            ],
            ["rep", "links", "other"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for k in range(batch.num_rows):
                yield one(batch.slice(k, 1).to_pylist()[0], forest)

    return pairs.mapInArrow(work, "rep long, links long, other long")


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a <= b: tiles whose boxes come near enough.

    Cosine >= t means a distance of at most sqrt(2 - 2t), so tiles meet only in
    equal or neighbouring cells of that width on the first axis: an equi-join.
    """
    reach2 = max(2 - 2 * threshold, 0.0) + 1e-5
    width = reach2**0.5
    box = tiles.select("tile", "dim", "lo", "hi")
    cell = lambda c: F.floor(F.element_at(c, 1) / F.lit(width)).cast("long")
    left = box.select(F.col("tile").alias("a"), "dim", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.explode(F.sequence(cell(F.col("lo")) - 1, cell(F.col("hi")) + 1)).alias("cell"))
    right = box.select(F.col("tile").alias("b"), "dim", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    gaps = F.zip_with(
        F.zip_with("a_lo", "b_hi", lambda x, y: x - y),
        F.zip_with("b_lo", "a_hi", lambda x, y: x - y),
        lambda p, q: F.pow(F.greatest(p, q, F.lit(0.0)), F.lit(2.0)),
    )
    near = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x) <= reach2
    return left.join(right, ["dim", "cell"]).where((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept. ``threshold`` is in (0, 1]."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType
    want = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast(want).alias("v"))
    good = rows.where(usable(F.col("v")))
    distinct = good.groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    reps = materialize(distinct.select(F.monotonically_increasing_id().alias("rep"), "copies", "first", F.size("v").alias("dim"), "v"), "vectors")

    n = reps.count()
    turned = _turn(reps, fit_axes(reps))
    parts = min(max(1, -(-n // tile)), 1 << 20)
    laid = turned.repartitionByRange(parts, "dim", "stratum", "first", "rep").sortWithinPartitions("dim", "stratum", "first", "rep")
    tiles = materialize(_pack(laid, want == "array<double>", tile), "tiles")

    side = lambda s: tiles.select(F.col("tile").alias(s), F.col("tile").alias(f"{s}_tile"), *[F.col(c).alias(f"{s}_{c}") for c in ("reps", "copies", "turned", "raw")], *(["dim", "wide"] if s == "a" else []))
    near = materialize(tile_pairs(tiles, threshold).repartition(n_partitions(spark), "a", "b"), "tile-pairs")
    both = near.join(side("a"), "a").join(side("b"), "b").drop("a", "b")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")  # a row holds two tiles
    try:
        found = materialize(_compare(both, threshold), "links")
    finally:
        spark.conf.set(key, before)

    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts_of = connected_components(found.where("other is not null"), "rep", "other").withColumnRenamed("node", "rep")
    known = (
        reps.select("rep", "copies", "first")
        .join(parts_of, "rep", "left")
        .join(links, "rep", "left")
        .select(
            "rep",
            "first",
            F.coalesce("component", "rep").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    about = materialize(known.join(least, "component").select("rep", "n_links", "component_id"), "classes")
    by_vector = reps.select("rep", F.col("v").alias("key")).join(about, "rep").drop("rep")
    # unusable vectors have no key, so they match nothing
    keyed = rows.select("vec_id", usable(F.col("v")).alias("good"), "v").select("vec_id", "good", F.when(F.col("good"), F.col("v")).alias("key"))
    joined = spread_join(keyed, by_vector, "key", ["vec_id"], "left")
    out = joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id")).cast("long").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs, and the smallest id reached step by step.
ORACLE_SQL = r"""
with recursive good as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.95),
reached as (select a as node, a as to_node from links union select r.node, l.b from reached r join links l on l.a = r.to_node),
least as (select node, min(to_node) as component_id from reached group by node),
counted as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(c.n, 0) as n_links, coalesce(l.component_id, e.vec_id) as component_id, coalesce(l.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join counted c on c.a = e.vec_id left join least l on l.node = e.vec_id
"""
