"""SimHash near-duplicates, linked exactly through vantage-point trees.

Each document gets a 64-bit fingerprint of its word shingles. Equal fingerprints collapse
to one row before anything is compared. Of fingerprints cut into ``bits // 2 + 1`` blocks (three for 4 bits), two
that differ in at most ``bits`` bits differ in at most one bit of some block; so each block has
its own vantage-point tree over Hamming distance in that block, searched with radius 1. In 64
dimensions at once the triangle bound would prune nearly nothing.

A tree's nodes hold a vantage point and the median distance to it, fitted on a sample that grows
with the tree. Each fingerprint has one home shard (a leaf); it also queries the shards that its
ball reaches across a boundary. The triangle bound says which nodes a ball crosses, and of a ball
that crosses, which of its points lie on which side, so a subtree is entered only for points
that can be there: a ball of 22 or 23 points never reaches more shards than that, however deep the
tree. Of two fingerprints with different homes only the one of the lower home queries the other.

In a shard the same search goes on down to small leaves, whose homes are compared on all 64 bits
with homes and queries. A hot shard is split by exact values of other blocks: two fingerprints
that differ in at most ``bits`` bits agree in one of ``bits + 1`` parts of the bits outside the
shard's block. What still is hot is cut into chunks of homes and chunks of rows that meet in a grid, so no
task holds more than two chunks. Homes make a shard hot, guests only where they are far more than balls explain. A comparison returns a shallow
spanning forest of its links, never all pairs of a group; components come from minimum-label
joins with pointer jumping over written tables.

Defined cases: a null or blank text has fingerprint zero and links like any other; ties
and repeated rows share a fingerprint; a null ``doc_id`` is never a component's name unless
all its members are null; an empty table gives an empty result; other columns are ignored.
:func:`drop_near_duplicates` keeps one row of each component, that of the smallest ``doc_id``
(nulls last, ties by text), whether ids are null, repeated or not, with all its columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.workspace import free_name, map_rows, text_keys, written

#: Fingerprints aimed at in a shard; homes above which a shard is hot; rows for each of these above which it is as well.
SHARD, HOT, GUESTS = 8192, 65536, 16
#: Levels of a tree at most (hot shards are split by other blocks), sampled fingerprints a shard.
LEVELS, SAMPLE = 16, 16
#: Homes of a leaf, inside a shard, that are compared without another split.
SMALL = 256


def fingerprint(text: str | None, width: int = 4) -> int:
    """Majority bits of XXH64 (seed 42) over the word shingles, repeats included; words split at ASCII white space, A-Z lowered."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        counts += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, the two keys of its text and its fingerprint as a signed long."""

    def prints(b: pd.DataFrame) -> pd.DataFrame:
        fp = np.fromiter((fingerprint(t, width) for t in b["text"]), np.uint64, len(b)).view(np.int64)
        return pd.DataFrame({"key_1": b["key_1"].to_numpy(), "key_2": b["key_2"].to_numpy(), "fp": fp})

    first, second = text_keys()
    keyed = docs.select("doc_id", "text", first.alias("key_1"), second.alias("key_2"))
    return map_rows(keyed, "doc_id", ["text", "key_1", "key_2"], lambda: prints, "key_1 long, key_2 long, fp long")


class Ball:
    """Balls of radius ``reach`` (0 or 1) in a block of bits, as masks of their points: a bit of the block for the point
    that differs in it, and a bit outside the block for the centre itself."""

    def __init__(self, mask: int, reach: int):
        self.mask, self.centre = np.uint64(mask), np.uint64(1 if not mask & 1 else 1 << 63)
        self.points = self.centre | self.mask if reach else self.centre

    def inside(self, x: np.ndarray, vantage: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which points of each ball lie within the radius: all or none by the triangle bound, else those on that side."""
        apart = (x ^ vantage) & self.mask
        d = np.bitwise_count(apart).astype(np.int64)
        out = np.where(d < radius, self.mask | self.centre, np.uint64(0))
        # a point that differs where centre and vantage point agree is one step further away, else one step nearer
        out = np.where(d == radius, apart | self.centre, out)
        return np.where(d == radius + 1, apart, out)


def vantage_point(x: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int, np.ndarray]:
    """Of a few candidates the one whose median distance cuts most evenly, with the radius, and the rows within it."""
    best = None
    for v in x[:: max(1, len(x) // 8)][:8] & mask:
        d = np.bitwise_count((x & mask) ^ v).astype(np.int64)
        middle = int(np.median(d))
        for r in (middle - 1, middle):
            uneven = abs(2 * int((d <= r).sum()) - len(d))
            if best is None or uneven < best[0]:
                best = (uneven, v, r, d <= r)
    return best[1:]


class VantageTree:
    """A tree of ``depth`` levels over values of a bit block: arrays of vantage points and radii by heap index.

    A node without enough of the sample splits no further: everything goes to its first child.
    """

    def __init__(self, sample: np.ndarray, mask: int, depth: int, reach: int):
        self.ball, self.depth = Ball(mask, reach), depth
        self.vantage, self.radius = np.zeros(2**depth, np.uint64), np.full(2**depth, 65, np.int64)
        rows = {1: sample & np.uint64(mask)}
        for node in range(1, 2**depth):
            x = rows.pop(node)
            inside = np.ones(len(x), bool)
            if len(x) >= 4:
                self.vantage[node], self.radius[node], inside = vantage_point(x, np.uint64(mask))
            rows[2 * node], rows[2 * node + 1] = x[inside], x[~inside]

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, shards, and whether it is the row's home, for every shard from the home on that a row's ball reaches."""
        row, node, live = np.arange(len(fps)), np.ones(len(fps), np.int64), np.full(len(fps), self.ball.points)
        for _ in range(self.depth):
            inside = self.ball.inside(fps[row], self.vantage[node], self.radius[node])
            near, far = live & inside, live & ~inside
            a, b = near != 0, far != 0
            row, node, live = np.concatenate((row[a], row[b])), np.concatenate((2 * node[a], 2 * node[b] + 1)), np.concatenate((near[a], far[b]))
        own = (live & self.ball.centre) != 0
        home = np.empty(len(fps), np.int64)
        home[row[own]] = node[own]
        up = node >= home[row]
        return row[up], node[up] - 2**self.depth, own[up]


def block_masks(blocks: int, within: int = 2**64 - 1) -> list[int]:
    """The bits of ``within`` dealt to blocks of neighbours."""
    places = [b for b in range(64) if within >> b & 1]
    edges = [len(places) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in places[a:z]) for a, z in zip(edges, edges[1:], strict=False)]


def compared(x: np.ndarray, homes: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that connect whatever lies within ``bits`` of one of the first ``homes`` values.

    A connected group of m comes back as m - 1 links, no position with more than 17 of them.
    """
    label, hit_rows = np.arange(len(x)), np.zeros(len(x), bool)
    for lo in range(0, homes, 256):
        own = np.arange(lo, min(homes, lo + 256))
        hit = np.bitwise_count(x[own, None] ^ x[None, :]) <= bits
        hit[own - lo, own] = False
        for i in np.flatnonzero(hit.any(1)):
            others = label[hit[i]]
            least = min(int(others.min()), int(label[lo + i]))
            hit_rows[lo + i] = True
            hit_rows |= hit[i]
            if others.max() != least or label[lo + i] != least:
                merged = np.zeros(len(x), bool)
                merged[others] = merged[label[lo + i]] = True
                label[merged[label]] = least
    rows = np.flatnonzero(hit_rows)
    rows = rows[np.argsort(label[rows], kind="stable")]
    own = label[rows]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    child = np.flatnonzero(place > 0)
    return rows[child], rows[child - place[child] + (place[child] - 1) // 16]


def linked(fps: np.ndarray, home: np.ndarray, mask: int, reach: int, bits: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Links (values) of a shard: of its homes among themselves and with those that query it.

    Goes on as the trees do: homes are split by a vantage point, queries follow their balls, and of two homes that part
    the inner one queries the outer.
    """
    ball, out = Ball(mask, reach), []
    order = np.argsort(~home, kind="stable")
    fps, n = fps[order], int(home.sum())
    todo = [(np.arange(len(fps)), n)]
    while todo:
        at, homes = todo.pop()
        if homes > small:
            v, r, near = vantage_point(fps[at[:homes]], ball.mask)
            if 0.05 * homes < near.sum() < 0.95 * homes:
                inside = ball.inside(fps[at], v, np.int64(r))
                into, beyond = (ball.points & inside) != 0, (ball.points & ~inside) != 0
                into[:homes], beyond[:homes] = near, beyond[:homes]
                outer = np.flatnonzero(~near)
                guests = np.flatnonzero(beyond & np.concatenate((near, np.ones(len(at) - homes, bool))))
                todo += [(at[into], int(near.sum())), (at[np.concatenate((outer, guests))], len(outer))]
                continue
        if homes and len(at) > 1:
            a, b = compared(fps[at], homes, bits)
            out.append((fps[at[a]], fps[at[b]]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def split_hot(routed: DataFrame, masks: list[int], bits: int, hot: int) -> DataFrame:
    """block, tile, home, fp: shards as they are, hot ones by exact values of parts of the other bits, then by a grid of chunks."""
    whole = F.struct("block", "shard", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("row"), F.lit(0).alias("column")).alias("tile")
    homes, rows = F.sum(F.col("home").cast("int")), F.count(F.lit(1))
    sizes = routed.groupBy("block", "shard").agg(homes.alias("homes"), rows.alias("rows")).filter((F.col("homes") > hot) | (F.col("rows") > GUESTS * hot))
    sizes = written(sizes.select("block", "shard"), "simhash-hot")
    if sizes.isEmpty():
        return routed.select("block", whole, "home", "fp")
    on = ["block", "shard"]
    cold = routed.join(sizes, on, "left_anti").select("block", whole, "home", "fp")
    parts = F.array(*[F.array(*[F.lit(_signed(p)).cast("long") for p in block_masks(bits + 1, ~m & (2**64 - 1))]) for m in masks])
    cells = routed.join(sizes, on, "left_semi").select("block", "shard", "home", "fp", F.posexplode(parts[F.col("block")]).alias("part", "bits")).withColumn("value", F.col("fp").bitwiseAND(F.col("bits")))
    keys = [*on, "part", "value"]
    cells = written(cells.drop("bits"), "simhash-cells")
    chunks = lambda n: F.greatest(F.ceil(n / F.lit(hot)), F.lit(1)).cast("int")
    cuts = cells.groupBy(*keys).agg(chunks(homes).alias("m"), chunks(rows).alias("n")).filter("m * n >= 1")
    dealt = cells.join(cuts, keys).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), "m").cast("int")).withColumn("at", F.pmod(F.xxhash64("fp", F.lit(8)), "n").cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tile = lambda row, column, home: F.struct(row.alias("row"), column.alias("column"), F.lit(home).alias("home"))
    # a home meets all rows, chunk by chunk; a row is a guest of every chunk of homes, but of its own where it is one of them
    as_home = F.when(F.col("home"), F.transform(every("n"), lambda j: tile(F.col("own"), j, True))).otherwise(F.array().cast("array<struct<row: int, column: int, home: boolean>>"))
    as_guest = F.transform(F.filter(every("m"), lambda i: ~F.col("home") | (i != F.col("own"))), lambda i: tile(i, F.col("at"), False))
    dealt = dealt.select(*keys, "fp", F.explode(F.concat(as_home, as_guest)).alias("t"))
    return cold.unionByName(dealt.select("block", F.struct(*keys, "t.row", "t.column").alias("tile"), "t.home", "fp"))


def links(unique: DataFrame, bits: int = 4, shard: int = SHARD, hot: int = HOT, small: int = SMALL) -> DataFrame:
    """Distinct links (a, b) of the unique fingerprints ``fp`` that give the components at ``bits`` or fewer differing bits."""
    n = unique.count()
    blocks = max(2, bits // 2 + 1)
    reach, masks = bits // blocks, block_masks(blocks)
    depth = min(LEVELS, 64 // blocks, max(0, int(np.ceil(np.log2(max(1, n) / shard)))))
    place = F.xxhash64("fp") / F.lit(2.0**64) + 0.5
    sample = np.sort(unique.filter(place * n < SAMPLE * 2**depth).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64))  # about a million at most
    trees = [VantageTree(np.random.default_rng(k).permutation(sample), m, depth, reach) for k, m in enumerate(masks)]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy(np.int64).view(np.uint64)
            for k, tree in enumerate(trees):
                row, at, home = tree.route(fps)
                yield pd.DataFrame({"block": np.int32(k), "shard": at, "home": home, "fp": fps[row].view(np.int64)})

    routed = written(unique.select("fp").mapInPandas(route, "block int, shard long, home boolean, fp long"), "simhash-routed")

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        fps = b["fp"].to_numpy(np.int64).view(np.uint64)
        a, z = (x.view(np.int64) for x in linked(fps, b["home"].to_numpy(bool), masks[int(b["block"].iloc[0])], reach, bits, small))
        return pd.DataFrame({"a": np.minimum(a, z), "b": np.maximum(a, z)})

    return split_hot(routed, masks, bits, hot).groupBy("tile").applyInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and its component's smallest node, for links (a, b) of longs: minimum labels, pointer jumping, until nothing changes."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        step = label.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        step = written(step, "labels")
        above = step.select(F.col("node").alias("label"), F.col("label").alias("above")).join(step.select("label").distinct(), "label")
        above = written(above, "labels-above")
        label = written(step.join(above, "label").select("node", "was", F.col("above").alias("label")), "labels")
        if label.filter("label <> was").isEmpty():
            return label.select("node", "label")
        label = label.select("node", "label")


def _classes(prints: DataFrame, bits: int) -> DataFrame:
    """fp, the fp that names its component, and the component's row that stays: (no_id, doc_id, key_1, key_2)."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_1", "key_2")
    unique = written(prints.groupBy("fp").agg(F.min(row).alias("first")), "simhash-unique")
    group = components(written(links(unique, bits), "simhash-links"))
    members = written(group.join(unique.withColumnRenamed("fp", "node"), "node"), "simhash-members")
    named = written(members.groupBy("label").agg(F.min("first").alias("best")), "simhash-names")
    named = written(members.join(named, "label").select(F.col("node").alias("fp"), "best"), "simhash-named")
    return written(unique.join(named, "fp", "left").select("fp", F.coalesce("best", "first").alias("best")), "simhash-classes")


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """One row a document: doc_id, fp (signed long), component_id: the smallest doc_id within reach, itself included."""
    prints = written(with_fingerprints(docs, width), "simhash-prints")
    return prints.join(_classes(prints, bits), "fp").select("doc_id", "fp", F.col("best.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """One row of each component, with all its columns."""
    prints = written(with_fingerprints(docs, width), "simhash-prints")
    row = ["doc_id", "key_1", "key_2"]
    found = prints.join(_classes(prints, bits), "fp").select(*row, (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key_1") == F.col("best.key_1")) & (F.col("key_2") == F.col("best.key_2"))).alias("stays"))
    found = written(found, "simhash-found")
    g = found.filter("not stays").select(*row).alias("g")
    keys = [free_name(docs, k) for k in ("_key_1", "_key_2")]
    d = docs.withColumns(dict(zip(keys, text_keys(), strict=True))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{keys[0]}") == F.col("g.key_1")) & (F.col(f"d.{keys[1]}") == F.col("g.key_2"))
    left = d.join(g, same, "left_anti")
    if not found.filter("stays").groupBy(*row).count().filter("count > 1").isEmpty():  # the row that stays is there more than once
        left = left.dropDuplicates(["doc_id", *keys])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
