"""Conversation repair against a search over all edit scripts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, cost int, word string"
WHITE = " \t\n\x0b\x0c\r"


def conversations(seed: int = 5, n: int = 260) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 6)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "User"])
            text = r.choice(["Hi.", "Hi. \n", "no end", "", None, " \t", "so?", "Was ist? ", "ß!", "a. ", "x" * 5000 + "."])
            rows.append((conv, r.choice([turn, turn, turn * 2, None]), role, text, 7, "other"))
    return rows + rows[:9] + [(None, 1, "user", "Hi.", 0, ""), (None, 2, "assistant", "Ho.", 0, ""), (-3, 2**40, "user", "Hi.", 0, "")]


def broken(rows: list[tuple]) -> dict:
    """The contract's damage, by conversation: (turn, role, text) in order."""
    out: dict = {}
    for conv, turn, role, text, *_ in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, own in out.items()}


def faults(rows: list[tuple]) -> list[str]:
    seen, found = set(), []
    for _, role, text in rows:
        end = text.rstrip(WHITE)
        found.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows: list[tuple]) -> tuple[int, str, str]:
    """Best (cost, audit, lines) by trying everything: at most two insertions at any place."""
    kinds, best = faults(rows), [(2 * len(rows), "D" * len(rows), "")]

    def go(i: int, cost: int, audit: str, lines: list[str], shape: str, added: int) -> None:
        if cost > best[0][0] or not re.fullmatch("s?(ua)*u?", shape):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            best[:] = [min([*best, (cost, audit, "\n".join(lines))])]
        if added < 2:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*lines, f"{role}:"], shape + role[0], added + 1)
        if i == len(rows):
            return
        _, role, text = rows[i]
        go(i + 1, cost + 2, audit + "D", lines, shape, 0)
        if kinds[i] in ("blank", "duplicate"):
            return
        more = 5 * (kinds[i] == "truncated")
        go(i + 1, cost + more, audit + "K", [*lines, f"{role}:{text}"], shape + (role[:1] or "-"), 0)
        for new in ("user", "assistant"):
            go(i + 1, cost + 1 + more, audit + "R", [*lines, f"{new}:{text}"], shape + new[0], 0)

    go(0, 0, "", [], "", 0)
    return best[0]


def expected(rows: list[tuple]) -> dict:
    out = {}
    for conv, own in broken(rows).items():
        kinds, turns = faults(own), [t for t, _, _ in own if t is not None]
        firsts = [role[:1] for _, role, _ in own]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        cost, audit, lines = cheapest(own)
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


NAMES = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def test_repair_matches_the_search_over_all_scripts(spark):
    rows = conversations()
    got = repair.digests(repair.repair(repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3)))).collect()
    assert {r.conv_id: tuple(r[c] for c in NAMES) for r in got} == expected(rows) and len(got) == len(expected(rows))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.sampled_from(["a.", "b.", "c", ""])), max_size=6))
@settings(max_examples=150, deadline=None)
def test_trie_answers(rows):
    own = [(i, role, text) for i, (role, text) in enumerate(rows)]
    word = "".join("d" if f in ("blank", "duplicate") else (s.upper() if f else s) for f, s in zip(faults(own), [r[0] if r[0] in "sua" else "o" for _, r, _ in own], strict=True))
    trie = repair.Trie()
    trie.answer(word[: len(word) // 2] + "d")
    cost, audit, places, roles = trie.answer(word)
    lines = [f"{role or own[p - 1][1]}:{own[p - 1][2] if p else ''}" for p, role in zip(places, roles, strict=True)]
    assert (cost, audit, "\n".join(lines)) == cheapest(own)


def test_shared_prefixes_are_stepped_once():
    words = sorted({"".join(random.Random(i).choices("suaSUAOod", k=i % 7)) for i in range(500)})
    trie = repair.Trie()
    for w in words:
        trie.answer(w)
    assert trie.steps == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_long_conversations_and_empty_tables(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}.", 0, "") for t in range(3000)]
    got = repair.repair(repair.intact(spark.createDataFrame(rows, SCHEMA))).first()
    assert (got.cost, got.audit, got.gaps, len(got.repaired)) == (0, "K" * 3000, 0, 3000) and got.repaired[7].text == "7."
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("word,audit", [("", ""), ("s", "D"), ("u", "D"), ("ua", "KK"), ("uo", "KR"), ("aa", "RK"), ("aua", "DKK"), ("Ua", "DD")])
def test_small_words(word, audit):
    assert repair.Trie().answer(word)[1] == audit
