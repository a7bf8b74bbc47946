"""SimHash near-duplicates: exact links within a Hamming radius, found with vantage-point trees.

A fingerprint's bit is set if it is set in over half of the 64-bit hashes of the text's word shingles. The distinct
fingerprints are spread over shards by a vantage-point tree fitted on a bounded sample (``SAMPLE`` to ``MOST_SAMPLE``
fingerprints in hash order, used only to choose vantage points and split radii). A point at distance d from a node's vantage point goes inside if
d < mu and outside if d >= mu - radius; by the triangle inequality two points within the radius then share a leaf, and
branches beyond the bound are pruned. Each shard splits itself further by the same rule down to small leaves, compares
those in full and returns a spanning forest of their links, never all pairs. A shard that no vantage point can split
is linked exactly through midpoints instead: two fingerprints differ in at most two bits if and only if they share a key
among themselves and their one-bit flips, and a key has at most 65 holders.

Nulls and texts without a word have fingerprint zero and are linked like any other. Repeated or null doc_ids: one row
out per row in; a null doc_id is never the smallest unless the component has no other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_by_hash, materialize, sized, text_of, with_row_id
from .components import components

RADIUS = 2
#: Fingerprints in the sample and points in a shard, at least and at most: both grow with the table, so that each of a
#: shard's points is represented by some in the sample.
SAMPLE, MOST_SAMPLE = 1 << 14, 1 << 20
SHARD, MOST_SHARD = 1 << 15, 1 << 21
LEAF = 384
#: Midpoint keys that are sorted at a time, some 40 bytes each.
KEYS = 1 << 22
SEED = 42


def fingerprint(text: str, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), SEED)]
    else:
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = np.concatenate(([0], ends[: len(parts) - words]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(words: int = 3):
    """A column function from texts to fingerprints, as signed longs."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64))

    return of


# ---------------------------------------------------------------- vantage-point trees


def _far(points: np.ndarray, v: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(v)).astype(np.int64)


def choose(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 4) -> tuple[int, int, int] | None:
    """The vantage point and split distance that leave the smallest larger child; None if no split helps."""
    best = None
    for v in rng.choice(points, min(tries, len(points)), replace=False).tolist():
        counts = np.bincount(_far(points, v), minlength=66)
        below = np.concatenate(([0], np.cumsum(counts)))  # below[m]: points at distance < m
        for mu in range(1, 65):
            larger = max(int(below[mu]), len(points) - int(below[max(0, mu - radius)]))
            if best is None or larger < best[0]:
                best = (larger, v, mu)
    return best if best and best[0] <= 0.9 * len(points) else None


def build(sample: np.ndarray, total: int, shard: int, radius: int, rng: np.random.Generator) -> list:
    """Nodes (vantage point, mu, inside, outside) or (None, shard number, dense); children by index, the root first."""
    nodes: list = []
    scale = total / max(1, len(sample))

    def grow(points: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        big = len(points) * scale > shard and len(points) >= 32
        split = choose(points, radius, rng) if big else None
        if split is None:
            nodes[at] = (None, at, bool(len(points) * scale > 4 * shard))
            return at
        _, v, mu = split
        d = _far(points, v)
        inside, outside = grow(points[d < mu]), grow(points[d >= mu - radius])
        nodes[at] = (v, mu, inside, outside)
        return at

    grow(sample)
    return nodes


def route(points: np.ndarray, nodes: list, radius: int) -> Iterator[tuple[int, bool, np.ndarray]]:
    """The leaves that points go to: shard number, whether it is dense, the points' positions."""
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        node = nodes[at]
        if node[0] is None:
            yield node[1], node[2], rows
            continue
        d = _far(points[rows], node[0])
        todo += [(node[2], rows[d < node[1]]), (node[3], rows[d >= node[1] - radius])]


def _by_midpoints(points: np.ndarray, most: int = KEYS) -> tuple[np.ndarray, np.ndarray]:
    """Exact links of radius 2 as (point, least holder of a shared key). Keys are sorted some ``most`` at a time, by their hash, so that
    memory stays bounded however tight a cluster is."""
    passes, found = -(-65 * len(points) // most), []
    every = np.arange(len(points))
    for k in range(passes):
        keys, owner = [], []
        for bit in (0, *(1 << b for b in range(64))):
            flipped = points ^ np.uint64(bit)
            mine = every if passes == 1 else np.flatnonzero((flipped * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(passes) == k)
            keys.append(flipped[mine])
            owner.append(mine)
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        if not len(keys):
            continue
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        head = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(keys))))
        found.append(np.unique(np.stack([owner, head], 1)[owner != head], axis=0))
    links = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return points[links[:, 0]], points[links[:, 1]]


def _by_pairs(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among a leaf's points, each compared with each."""
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    touched = np.flatnonzero(near.sum(1) > 1)
    if not len(touched):
        return points[:0], points[:0]
    near, label = near[np.ix_(touched, touched)], np.arange(len(touched))
    while True:
        low = np.where(near, label[None, :], len(label)).min(1)
        if (low == label).all():
            break
        label = low
    own = np.arange(len(label))
    a, b = own[label != own], label[label != own]
    # a label may lie several links away; it is in the same component, which is all that the forest has to say
    return points[touched[a]], points[touched[b]]


def links(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF, seed: int = SEED) -> np.ndarray:
    """Edges that connect exactly the distinct points that a chain of links within ``radius`` connects; shape (n, 2)."""
    rng, found, todo = np.random.default_rng(seed), [], [np.unique(points)]
    while todo:
        some = todo.pop()
        if len(some) < 2:
            continue
        split = None if len(some) <= leaf else choose(some if len(some) <= 4096 else rng.choice(some, 4096, replace=False), radius, rng)
        if split is not None:
            d = _far(some, split[1])
            todo += [some[d < split[2]], some[d >= split[2] - radius]]
        elif len(some) <= 4 * leaf:
            found.append(_by_pairs(some, radius))
        else:
            found.append(_by_midpoints(some) if radius == 2 else _by_blocks(some, radius))
    if not found:
        return np.zeros((0, 2), np.uint64)
    return np.unique(np.stack([np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])], 1), axis=0)


def _by_blocks(points: np.ndarray, radius: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Each point with each, block by block, for other radii; returns each point's link to its least partner per block."""
    a, b = [], []
    for i in range(0, len(points), rows):
        for j in range(0, i + 1, rows):
            near = np.bitwise_count(points[i : i + rows, None] ^ points[None, j : j + rows]) <= radius
            x, y = np.nonzero(near)
            a.append(points[i + x])
            b.append(points[j + y])
    return np.concatenate(a), np.concatenate(b)


def near_components(prints: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """prints: fp (long), distinct and written. Gives vertex, root for the fingerprints that have a link."""
    total = prints.count()
    shard = min(max(shard, 64 * total // sample), max(shard, MOST_SHARD))
    sample = min(max(sample, 64 * total // MOST_SHARD), max(sample, MOST_SAMPLE))
    some = least_by_hash(prints.select("fp"), "fp", sample).toPandas()["fp"].to_numpy(np.int64)
    nodes = build(some.view(np.uint64), total, shard, radius, np.random.default_rng(SEED))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for number, dense, rows in route(points, nodes, radius):
                yield pd.DataFrame({"shard": np.full(len(rows), number), "dense": dense, "fp": points[rows].view(np.int64)})

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        edges = links(group["fp"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"u": np.ascontiguousarray(edges[:, 0]).view(np.int64), "v": np.ascontiguousarray(edges[:, 1]).view(np.int64)})

    placed = prints.select("fp").mapInPandas(spread, "shard long, dense boolean, fp long")
    has_dense = any(x[0] is None and x[2] for x in nodes) and radius == 2
    usual = placed.filter("not dense") if has_dense else placed
    edges = usual.groupBy("shard").applyInPandas(solve, "u long, v long")
    if has_dense:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
        keys = placed.filter("dense").select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("key"))
        holders = keys.groupBy("key").agg(F.collect_set("fp").alias("all"), F.min("fp").alias("u")).filter(F.size("all") > 1)
        edges = edges.unionByName(holders.select("u", F.explode("all").alias("v")).filter("u <> v"))
    return components(edges)


def _printed(docs: DataFrame, columns: list[str], text_col: str, words: int) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    return materialize(with_row_id(docs.select(row, fingerprints(words)(text_of(F.col(f"`{text_col}`"))).alias("fp")), "rid"))


def _resolved(printed: DataFrame, id_col: str, radius: int) -> DataFrame:
    """fp, component_id and the row that stands for the component, for every distinct fingerprint."""
    head = F.min(F.struct(F.col("row")[id_col].isNull().alias("none"), F.col("row")[id_col].alias("doc_id"), F.col("rid")))
    prints = materialize(printed.groupBy("fp").agg(head.alias("head")))
    roots = materialize(near_components(prints, radius))
    rooted = prints.join(roots, prints["fp"] == roots["vertex"], "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("head").alias("first"))
    return materialize(rooted.join(heads, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.rid").alias("keep_rid")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    printed = _printed(docs, [id_col], text_col, words)
    out = printed.join(sized(_resolved(printed, id_col, radius)), "fp")
    return out.select(F.col("row")[id_col].alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns."""
    printed = _printed(docs, docs.columns, text_col, words)
    keep = _resolved(printed, id_col, radius).select(F.col("keep_rid").alias("rid")).distinct()
    gone = materialize(printed.select("rid").join(keep, "rid", "left_anti"))
    return printed.join(sized(gone), "rid", "left_anti").select("row.*")
