"""The manifest against a plain Merkle tree over lists."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from basketry.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, grp int"
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def rows(seed: int, sizes: dict) -> list[tuple]:
    r, out = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            text = r.choice(["", None, "Abc é", "x" * 9000, "Same", "low", f"Text {r.random()}"])
            out.append((r.choice([None, *range(10 * n)]), text, r.choice(["en", None, ""]), source, r.choice([None, 3]), "clash", 1))
    return out + out[:3] + out[:1]


def leaf(doc_id, text, lang, source, n_chars, *_) -> str:
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(map(told, (doc_id, source, lang, n_chars, text)))


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def path(levels: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    found = []
    for level in levels[:-1]:
        first = i // 16 * 16
        found.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return found


def expected(table: list[tuple]) -> list[tuple]:
    order = sorted({r[3] for r in table}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in table if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in order}
    trees = {s: tree([leaf(*r) for r in own[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(own[s]):
            steps = path(trees[s], i) + path(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            folded = leaf(r[0], r[1].translate(ASCII), *r[2:]) if tampered else leaf(*r)
            for before, after in steps:
                folded = H([*before, folded, *after])
            out.append((str(r[0]), leaf(*r), trees[s][-1][0], top[-1][0], H(x for step in steps for side in step for x in side), folded, folded == top[-1][0]))
    return sorted(out)


NAMES = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


@pytest.mark.parametrize("sizes", [{"hot": 700, None: 40, "": 1, "é": 17, "z": 16, "a": 257}, {"one": 1}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_matches_a_plain_tree(spark, sizes):
    table = rows(3, sizes)
    got = manifest.of_documents(spark.createDataFrame(table, SCHEMA).repartition(3)).collect()
    assert sorted(tuple(str(r[c]) if c == "doc_id" else r[c] for c in NAMES) for r in got) == expected(table)
    assert {r.verified for r in got} >= {True}


def test_manifest_of_nothing(spark):
    assert manifest.of_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256])
def test_levels_and_siblings_of_a_block(n):
    leaves = [H([str(i)]) for i in range(n)]
    levels = manifest.levels_of(manifest.as_matrix([x.encode() for x in leaves]), manifest._height(n))
    want = tree(leaves)
    assert [[r.tobytes().decode() for r in level] for level in levels] == want
    for i in (0, n // 2, n - 1):
        assert manifest.siblings(levels, i) == [tuple("".join(side).encode() for side in step) for step in path(want, i)]
        assert manifest.fold(leaves[i].encode(), manifest.siblings(levels, i)).decode() == want[-1][0]
