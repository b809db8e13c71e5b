"""Merkle manifest of a dataset: a digest that any row can be checked against.

Every row is a leaf. Leaves of a group ascend by identifier; every ``FANOUT`` consecutive nodes
are hashed into one of the next level, a last run of fewer as well, until one remains: the
group's root. The roots of all groups, by name, form the tree whose root is the manifest's.

A leaf is hashed where its row is scanned, so only digests move. A row's place in its group
comes from one range partitioning and the counts of its parts, not from one sort per group, so a
group may hold most of the table. Trees are made of aligned blocks of ``BLOCK`` leaves, a power of the
fanout: a block's digests stand in one numpy matrix of 64-byte hex digests, each level is hashed
from that matrix reshaped to runs, and a node's siblings are the rows of its run without its own,
by index arithmetic. The tops of the blocks are the leaves of the next round, of which there are
as many as the height needs (BLOCK rows less each time). On the way back each block gets the
siblings above it, so a row's proof is made without any other row of its group.

Defined cases: a null field is ``-``, so it differs from an empty one; a null group is a group of
its own and the first; null identifiers come first; rows of one identifier go by their digest;
repeated rows are leaves of their own; very long texts are hashed whole; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from basketry.llm.workspace import ascii_lower, written

FANOUT, HEX = 16, 64
#: Leaves of an aligned block: what one matrix holds, and a power of the fanout.
LEVELS = 2
BLOCK = FANOUT**LEVELS
#: Rows that a call works on, about: many small blocks at once.
ROWS = 20_000


def field(c: Column) -> Column:
    """UTF-8 byte count, a colon and the value; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def levels_of(digests: np.ndarray, height: int) -> list[np.ndarray]:
    """The matrix (n, 64) of hex digests and ``height`` levels over it."""
    levels = [digests]
    for _ in range(height):
        below = levels[-1]
        whole = len(below) // FANOUT
        runs = [r.tobytes() for r in below[: whole * FANOUT].reshape(whole, FANOUT * HEX)]
        if whole * FANOUT < len(below):
            runs.append(below[whole * FANOUT :].tobytes())
        levels.append(as_matrix([hashlib.sha256(r).hexdigest().encode() for r in runs]))
    return levels


def as_matrix(hexes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hexes), np.uint8).reshape(len(hexes), HEX)


def siblings(levels: list[np.ndarray], i: int) -> list[tuple[bytes, bytes]]:
    """The rest of the run that holds leaf ``i``, before and after it, on every level but the top."""
    found = []
    for level in levels[:-1]:
        first = i - i % FANOUT
        found.append((level[first:i].tobytes(), level[i + 1 : first + FANOUT].tobytes()))
        i //= FANOUT
    return found


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        digest = hashlib.sha256(before + digest + after).hexdigest().encode()
    return digest


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, from 0 within ``grp`` by ``order``, and ``n``, the rows of the group; rows that tie in all are alike."""
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())  # repeated rows are dealt out as well
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["grp", *order, "_tie"]
    ordered = written(rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "manifest-ordered")
    within = Window.partitionBy("part", "grp").orderBy(*order, "_tie")
    counts = ordered.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("grp")
    before = F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("grp").alias("g"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("m").over(whole).alias("n"))
    numbered = ordered.withColumn("row", F.row_number().over(within))
    both = numbered.join(counts, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return both.select("grp", (F.col("before") + F.col("row") - 1).alias("pos"), "n", *[c for c in rows.columns if c not in ("grp", "_tie")])


def _height(n: int) -> int:
    """Levels above ``n`` leaves, within a block."""
    height = 0
    while height < LEVELS and n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


def _by_block(nodes: DataFrame, solve: Callable, schema: str, paths: DataFrame | None = None) -> DataFrame:
    """``solve(columns, first, end, above)`` for whole blocks of (grp, n, pos, digest, ...), many a call; it gives rows of the schema.

    ``paths`` (grp, pos, path) has what is above each block; blocks are bounded, so calls are.
    """
    calls = max(nodes.count() // ROWS, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = StructType.fromDDL(schema).names

    def run(b: pd.DataFrame, p: pd.DataFrame | None = None) -> pd.DataFrame:
        b = b.sort_values(["grp", "block", "pos"], ignore_index=True)
        cols = {c: b[c].to_numpy() for c in b.columns}
        new = np.flatnonzero((np.diff(cols["grp"]) != 0) | (np.diff(cols["block"]) != 0)) + 1
        at = [0, *new.tolist(), len(b)] if len(b) else []
        above = {} if p is None else dict(zip(zip(p["grp"], p["block"], strict=True), p["path"], strict=True))
        return pd.DataFrame([r for lo, hi in zip(at, at[1:], strict=False) for r in solve(cols, lo, hi, above.get((cols["grp"][lo], cols["block"][lo])))], columns=names)

    call = F.pmod(F.xxhash64("grp", "block"), F.lit(calls))
    grouped = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).withColumn("call", call).groupBy("call")
    if paths is None:
        return grouped.applyInPandas(lambda b: run(b), schema)
    over = paths.withColumnRenamed("pos", "block").withColumn("call", call).groupBy("call")
    return grouped.cogroup(over).applyInPandas(lambda b, p: run(b, p), schema)


def _levels(cols: dict, lo: int, hi: int) -> list[np.ndarray]:
    return levels_of(as_matrix([d.encode() for d in cols["digest"][lo:hi]]), _height(int(cols["n"][lo])))


def _tops(cols: dict, lo: int, hi: int, above: None) -> list[tuple]:
    return [(cols["grp"][lo], cols["block"][lo], -(-int(cols["n"][lo]) // BLOCK), _levels(cols, lo, hi)[-1].tobytes().decode())]


def _down(cols: dict, lo: int, hi: int, above: Sequence[str]) -> list[tuple]:
    """Each node's own siblings, then those above its block: before and after by turns, lowest level first."""
    levels = _levels(cols, lo, hi)
    return [(cols["grp"][k], cols["pos"][k], [x.decode() for pair in siblings(levels, k - lo) for x in pair] + list(above)) for k in range(lo, hi)]


def _prove(cols: dict, lo: int, hi: int, above: Sequence[str]) -> list[tuple]:
    """A leaf's proof, and what its changed digest folds to."""
    levels, over = _levels(cols, lo, hi), [x.encode() for x in above]
    pairs = list(zip(over[::2], over[1::2], strict=True))
    rows = []
    for k in range(lo, hi):
        path = siblings(levels, k - lo) + pairs
        proof = hashlib.sha256(b"".join(x for pair in path for x in pair)).hexdigest()
        rows.append((cols["id"][k], cols["digest"][k], proof, fold(cols["changed"][k].encode(), path).decode(), cols["grp"][k]))
    return rows


def climb(nodes: DataFrame) -> list[DataFrame]:
    """(grp, pos, n, digest) of the leaves and of the blocks' tops, round by round, until each group has one."""
    rounds = [nodes.select("grp", "pos", "n", "digest")]
    while not rounds[-1].filter("n > 1").isEmpty():
        tops = _by_block(rounds[-1].filter("n > 1"), _tops, "grp long, pos long, n long, digest string")
        rounds.append(written(tops.unionByName(rounds[-1].filter("n = 1")), "manifest-tops"))
    return rounds


def descend(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """(grp, pos, path) of the nodes of the lowest of ``rounds``, given what is above each group's root."""
    for nodes in reversed(rounds):
        paths = written(_by_block(nodes, _down, "grp long, pos long, path array<string>", paths), "manifest-paths")
    return paths


def manifest(rows: DataFrame) -> DataFrame:
    """Of rows (id, source, digest, changed): id, digest, subroot, root, proof_sha256 and folded_root.

    ``changed`` is the digest that is checked in place of ``digest``.
    """
    zero, names = F.lit(0).cast("long"), rows.select("source").distinct()
    names = written(placed(names.select(zero.alias("grp"), "source"), ["source"]).select(F.col("pos").alias("grp"), F.col("source").alias("s")), "manifest-groups")
    known = rows.join(names, F.col("source").eqNullSafe(F.col("s"))).select("grp", "id", "digest", "changed")
    leaves = written(placed(known, ["id", "digest"]), "manifest-leaves")
    rounds = climb(leaves)
    subroots = rounds[-1].select(F.col("grp").alias("pos"), "digest")
    top = climb(written(subroots.select(zero.alias("grp"), "pos", F.lit(names.count()).alias("n"), "digest"), "manifest-subroots"))
    root = top[-1].first()  # one digest
    to_root = descend(top, top[-1].select("grp", "pos", F.array().cast("array<string>").alias("path")))
    paths = descend(rounds[1:], to_root.select(F.col("pos").alias("grp"), zero.alias("pos"), "path"))
    proved = _by_block(leaves.withColumn("id", F.col("id").cast("string")), _prove, "id string, digest string, proof_sha256 string, folded_root string, grp long", paths)
    both = proved.join(subroots.select(F.col("pos").alias("grp"), F.col("digest").alias("subroot")), "grp")
    return both.select(F.col("id").cast(rows.schema["id"].dataType).alias("id"), "digest", "subroot", F.lit(root and root["digest"]).alias("root"), "proof_sha256", "folded_root")


def of_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents by source; every fifth row by the hash of its doc_id is checked with its text's A-Z lower-cased."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    digest = leaf([*columns, F.col("text")])
    changed = F.when(tampered, leaf([*columns, ascii_lower(F.col("text"))])).otherwise(digest)
    done = manifest(written(docs.select(F.col("doc_id").alias("id"), "source", digest.alias("digest"), changed.alias("changed")), "manifest-rows"))
    return done.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
