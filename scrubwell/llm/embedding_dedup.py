"""Near-duplicate embeddings by int8 tile products with error bounds, exact in double precision.

Equal vectors are one node. Nodes are laid out in tiles of some thousands, near ones together. A vector *x* of length 1 is
stored as ``scale * q`` with ``q`` in -127..127 and the length *e* of what is lost. For two vectors the product of the
quantised ones differs from the cosine by at most ``(1+e)f + e(1+f) + ef``, so a tile product (exact: int8 values in a float32
matrix product) settles all pairs but those within that bound of the threshold, which are computed from the full vectors.
Two tiles are compared only if the angle between their centres, less both radii, is within the threshold's angle.

A pair of tiles is one row and one step of a task. It gives every vector with a link there one row: the number of its
links, and a root of its connected part. So a group of near copies yields as many rows as members, not as many as pairs.

Vectors that are NULL, empty, zero, or hold a NULL or non-finite component link with nothing, nor do vectors of
different lengths with each other. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubwell.llm.batches import pieces
from scrubwell.llm.graphs import components, stored

THRESHOLD = 0.9
# Vectors of a tile; two tiles, their link matrix and a strip of products are in a task at a time.
TILE = 8192
STRIP = 512
# Vectors at most around which tiles are laid out, chosen by digest, one per full tile; they decide the layout only.
PIVOTS = 256
# Rounding of float32 products and scales, far above what they can differ by.
SLACK = 1e-5

_TILE = pa.schema(
    [
        ("dim", pa.int32()), ("tile", pa.int32()), ("nodes", pa.list_(pa.string())), ("copies", pa.binary()), ("quantised", pa.binary()),
        ("scale", pa.binary()), ("lost", pa.binary()), ("vectors", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()),
    ]
)
TILES = (
    "dim int, tile int, nodes array<string>, copies binary, quantised binary, scale binary, lost binary, "
    "vectors binary, centre array<double>, radius double"
)


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of length 1 as int8, their scales, and the lengths of what is lost (with a margin for this computation)."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    q = np.clip(np.rint(vectors / scale[:, None]), -127, 127)
    lost = np.linalg.norm(vectors - q * scale[:, None], axis=1) + 1e-12
    return q.astype(np.int8), scale, lost


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 without overflow."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _build(keys: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """A tile from its nodes, in the order of their names. The vectors are kept as they came."""
    dim, tile = keys[0].as_py(), keys[1].as_py()
    group = group.sort_by("node")
    given = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    vectors = unit(given.astype(np.float64))
    q, scale, lost = quantise(vectors)
    mean = vectors.mean(axis=0)
    length = np.linalg.norm(mean)
    centre = mean / length if length > 1e-9 else vectors[0]
    radius = float(np.arccos(np.clip((vectors @ centre).min() - 1e-9, -1, 1)))
    values = [
        dim, tile, group.column("node").to_pylist(), group.column("copies").to_numpy().tobytes(), q.tobytes(), scale.tobytes(),
        lost.tobytes(), given.tobytes(), centre.tolist(), radius,
    ]
    return pa.Table.from_arrays([pa.array([v], t.type) for v, t in zip(values, _TILE, strict=True)], schema=_TILE)


class Tile:
    """One side of a tile pair."""

    def __init__(self, row: dict, side: str, dim: int):
        self.copies = np.frombuffer(row[f"copies_{side}"], dtype=np.int64)
        self.q = np.frombuffer(row[f"quantised_{side}"], dtype=np.int8).reshape(-1, dim)
        self.scale, self.lost = (np.frombuffer(row[f"{c}_{side}"], dtype=np.float64) for c in ("scale", "lost"))
        kind = np.float32 if len(row[f"vectors_{side}"]) == 4 * self.q.size else np.float64
        self.vectors = unit(np.frombuffer(row[f"vectors_{side}"], dtype=kind).reshape(-1, dim).astype(np.float64))
        self.first = (dim << 48) + (row[f"tile_{side}"] << 24)


def link_matrix(a: Tile, b: Tile, threshold: float) -> np.ndarray:
    """Which vectors of two tiles have a cosine of ``threshold`` or more."""
    exact = np.float32 if a.q.shape[1] <= 1040 else np.float64  # sums of products stay below 2**24
    right = b.q.astype(exact).T
    scale_b = b.scale.astype(exact)
    links = np.zeros((len(a.q), len(b.q)), dtype=bool)
    most = b.lost.max()
    for at in range(0, len(a.q), STRIP):
        rows = slice(at, at + STRIP)
        products = (a.q[rows].astype(exact) @ right) * scale_b
        e = a.lost[rows]
        bound = (1 + e) * most + e * (1 + most) + e * most + SLACK
        i, j = np.nonzero(products >= ((threshold - bound) / a.scale[rows]).astype(exact)[:, None])
        value = products[i, j] * a.scale[rows][i]
        e, f = e[i], b.lost[j]
        bound = (1 + e) * f + e * (1 + f) + e * f + SLACK
        sure = value - bound >= threshold
        links[at + i[sure], j[sure]] = True
        open_ = np.flatnonzero(~sure & (value + bound >= threshold))
        for k in range(0, len(open_), 1 << 16):
            x, y = at + i[open_[k : k + (1 << 16)]], j[open_[k : k + (1 << 16)]]
            links[x, y] = np.einsum("nd,nd->n", a.vectors[x], b.vectors[y]) >= threshold
    return links


def spanning_roots(links: np.ndarray) -> np.ndarray:
    """The smallest node of each node's connected part in a symmetric link matrix; itself where it has no link."""
    root = np.arange(len(links))
    open_ = links.any(axis=1)
    while open_.any():
        start = int(np.argmax(open_))
        frontier = np.array([start])
        open_[start] = False
        while len(frontier):
            root[frontier] = start
            frontier = np.flatnonzero(links[frontier].any(axis=0) & open_)
            open_[frontier] = False
    return root


def _pair_roots(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and for columns of a link matrix, the first row of their connected part (-1 without a link)."""
    rows, columns = np.full(len(links), -1), np.full(links.shape[1], -1)
    open_rows, open_columns = links.any(axis=1), links.any(axis=0)
    while open_rows.any():
        start = int(np.argmax(open_rows))
        frontier = np.array([start])
        open_rows[start] = False
        while len(frontier):
            rows[frontier] = start
            met = np.flatnonzero(links[frontier].any(axis=0) & open_columns)
            open_columns[met] = False
            columns[met] = start
            frontier = np.flatnonzero(links[:, met].any(axis=1) & open_rows) if len(met) else met
            open_rows[frontier] = False
    return rows, columns


def _comparer(threshold: float):
    schema = pa.schema([("number", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            row = batch.to_pylist()[0]
            a, b = Tile(row, "a", row["dim"]), Tile(row, "b", row["dim"])
            links = link_matrix(a, b, threshold)
            if row["tile_a"] == row["tile_b"]:
                np.fill_diagonal(links, False)
                roots = spanning_roots(links)
                sides = [(a, links @ b.copies, roots)]
            else:
                of_rows, of_columns = _pair_roots(links)
                sides = [(a, links @ b.copies, of_rows), (b, links.T @ a.copies, of_columns)]
            for tile, n, roots in sides:
                has = np.flatnonzero(n)
                arrays = [pa.array(tile.first + has), pa.array(n[has]), pa.array(a.first + roots[has])]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return compare


def _usable(vector: Column) -> Column:
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(broken, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _layout(nodes: DataFrame, tile: int, kind: str) -> DataFrame:
    """The nodes with ``tile``, their place in the layout: by nearest pivot, large surroundings split by digest."""
    wanted = min(PIVOTS, -(-nodes.count() // tile))
    pivots = nodes.orderBy("node").select("dim", "vector").limit(wanted).collect()
    by_dim = {d: unit(np.array([p["vector"] for p in pivots if p["dim"] == d], dtype=np.float64)) for d in {p["dim"] for p in pivots}}
    sent = nodes.sparkSession.sparkContext.broadcast(by_dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            own = np.full(batch.num_rows, -1)
            dims = batch.column("dim").to_numpy()
            for dim, pivot in sent.value.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    vectors = batch.column("vector").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    own[at] = np.argmax(unit(vectors.astype(np.float64)) @ pivot.T, axis=1)
            columns = [*batch.columns, pa.array(own, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "pivot"])

    schema = f"node string, dim int, vector array<{kind}>, copies bigint, pivot int"
    assigned = stored(nodes.select("node", "dim", "vector", "copies").mapInArrow(assign, schema), "assigned")
    sizes = assigned.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("parts"))
    before = Window.partitionBy("dim").orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("start", F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("int"))
    placed = assigned.join(F.broadcast(sizes), ["dim", "pivot"])  # PIVOTS rows and one per dimension at most
    return placed.withColumn("tile", F.col("start") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector: ``vec_id``, ``n_links`` (other vectors with a cosine of ``threshold`` or more), ``component_id``
    (smallest id reachable by links), ``kept`` (whether that is its own)."""
    kind = "float" if embeddings.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    vector = F.transform(embeddings[vector_col].cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))  # no negative zeros
    rows = embeddings.select(embeddings[id_col].cast("bigint").alias("vec_id"), vector.alias("vector"))
    node = F.when(_usable(F.col("vector")), F.concat_ws("-", F.hex(F.xxhash64("vector")), F.hex(F.xxhash64(F.lit(1), "vector"))))
    rows = stored(rows.select("vec_id", "vector", node.alias("node")), "vectors")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("vector").alias("vector"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")
    )
    nodes = stored(nodes.withColumn("dim", F.size("vector")), "nodes")
    placed = _layout(nodes, tile, kind).select("dim", "tile", "node", "copies", "vector")
    tiles = stored(placed.groupBy("dim", "tile").applyInArrow(_build, TILES), "tiles")

    # Each tile with itself and with every later one in a circle, half of the circle, so all tiles have alike many.
    n = tiles.groupBy("dim").agg(F.count(F.lit(1)).cast("int").alias("of"))
    steps = F.explode(F.sequence(F.lit(0), F.floor((F.col("of") - 1) / 2).cast("int") + F.when((F.col("of") % 2 == 0) & (F.col("tile") < F.col("of") / 2), 1).otherwise(0)))
    small = tiles.select("dim", "tile", "centre", "radius")
    pairs = small.join(n, "dim").select("dim", F.col("tile").alias("tile_a"), "of", "centre", "radius", steps.alias("step"))
    pairs = pairs.withColumn("tile_b", (F.col("tile_a") + F.col("step")) % F.col("of"))
    other = small.select("dim", F.col("tile").alias("tile_b"), F.col("centre").alias("centre_b"), F.col("radius").alias("radius_b"))
    dot = F.aggregate(F.zip_with("centre", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("radius") - F.col("radius_b")
    near = stored(pairs.join(other, ["dim", "tile_b"]).filter(apart <= float(np.arccos(threshold)) + 1e-6).select("dim", "tile_a", "tile_b"), "tile-pairs")
    side = lambda s: tiles.select("dim", *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "copies", "quantised", "scale", "lost", "vectors")])  # noqa: E731, E501
    wide = near.join(side("a"), ["dim", "tile_a"]).join(side("b"), ["dim", "tile_b"])
    found = stored(wide.mapInArrow(_comparer(threshold), "number bigint, n bigint, root bigint"), "links")

    counts = found.groupBy("number").agg(F.sum("n").alias("n"))
    roots = components(found.select("number", "root"), "number", "root").withColumnRenamed("node", "number")
    numbers = tiles.select("dim", "tile", F.posexplode("nodes").alias("at", "node"))
    numbers = numbers.select("node", (F.shiftleft(F.col("dim").cast("bigint"), 48) + F.shiftleft(F.col("tile").cast("bigint"), 24) + F.col("at")).alias("number"))
    part = nodes.select("node", "vec_id", "copies").join(numbers, "node").join(counts, "number", "left").join(roots, "number", "left")
    part = part.select("node", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "number").alias("component"))
    part = stored(part, "parts")
    least = part.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    part = stored(part.join(least, "component").select("node", "n_links", "component_id"), "parts")
    joined = rows.select("vec_id", "node").join(part, "node", "left")
    component_id = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept")
    )
