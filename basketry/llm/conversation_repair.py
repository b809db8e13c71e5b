"""Conversation structure repair: the cheapest edits that make turns alternate.

Rows of a conversation, by turn, have a role and at most one fault: blank (nothing but white
space), duplicate (role and text came earlier) or truncated (does not end in ``.``, ``!`` or
``?``). An edit script keeps, reroles, deletes or inserts rows until the role initials read
``(s?(ua)+)?``, as cheaply as the costs below allow; of equally cheap scripts the one whose
initials are least in ASCII is taken.

Only roles and faults decide a script, so a conversation is a word of nine symbols. Distinct
words are sorted, and each task walks its range of them as a prefix trie: the layers of the
dynamic program stand on a stack, one for each symbol of the branch that is open, a word starts
from the layer of the prefix it shares with the word before it, and its answer is read off at its
last node. A branch that is closed is never needed again, as words come sorted, so memory is
bounded by the longest word. Many conversations share a word and no word is solved twice.

Defined cases: a null role or text is one space; null turns come first; rows of one turn go by
role, then text; a null conv_id is a conversation of its own; a role that starts with none of
``sua`` can't be kept; a conversation without rows needs no edit; very long texts are read
whole; other columns are ignored; an empty table gives an empty result. A conversation and its
script are one value each, so the longest conversation has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm.workspace import written

#: What edits cost; keeping or reroling a truncated row costs ``TRUNCATED`` more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
#: By the last role's initial (none at the start): the initials that may follow, and the role that an insertion adds.
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
ADDED = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Insertions that an end needs.
ENDING = {"": "", "s": "II", "u": "I", "a": ""}

#: By last role: cost, place among the layer's scripts in ASCII order, last role one layer up, edits since.
Layer = dict[str, tuple[int, int, str, str]]


def _layer(options: list[tuple[int, int, str, str, str]]) -> Layer:
    """The best of (cost, place, edits, role before, role after) for each role after.

    All scripts of a layer read the same rows and end in a row's edit, so none begins another and their order outlasts what is appended.
    """
    best: dict[str, tuple[int, int, str, str]] = {}
    for cost, place, edits, before, after in options:
        best[after] = min(best.get(after, (cost, place, edits, before)), (cost, place, edits, before))
    ranked = sorted(best, key=lambda s: best[s][1:3])
    return {s: (best[s][0], ranked.index(s), best[s][3], best[s][2]) for s in ranked}


def step(layer: Layer, symbol: str) -> Layer:
    """The layer after one more row. ``symbol``: the role's initial (``o``: another), in upper case if truncated; ``d``: has to go.

    Insertions stand before the row they make room for: before a deletion the later place is as cheap and comes first in ASCII.
    Two in a row would change nothing but the cost.
    """
    options = []
    role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    for before, (cost, place, _, _) in layer.items():
        options.append((cost + DELETE, place, "D", before, before))
        if role == "d":
            continue
        for last, added in ((before, ""), (ADDED[before], "I")):
            for new in FOLLOWS[last]:
                paid = cost + extra + INSERT * len(added)
                if new == role:
                    options.append((paid + KEEP, place, added + "K", before, new))
                elif new in ROLES:
                    options.append((paid + REROLE, place, added + "R", before, new))
    return _layer(options)


class Trie:
    """The open branch of the prefix trie of words that come sorted: a layer for every prefix of the last word."""

    def __init__(self) -> None:
        self.word, self.layers, self.steps = "", [{"": (0, 0, "", "")}], 0

    def descend(self, word: str) -> Layer:
        shared = 0
        for a, b in zip(self.word, word, strict=False):
            if a != b:
                break
            shared += 1
        del self.layers[shared + 1 :]
        for symbol in word[shared:]:
            self.layers.append(step(self.layers[-1], symbol))
        self.steps += len(word) - shared
        self.word = word
        return self.layers[-1]

    def answer(self, word: str) -> tuple[int, str, list[int], list[str]]:
        """Cost and initials of the best script, and what it makes: the row (from 1, an insertion 0) and the new role (or '') of each turn."""
        last = self.descend(word)
        cost, _, edits, state = min((cost + INSERT * len(ENDING[s]), place, ENDING[s], s) for s, (cost, place, _, _) in last.items())
        parts, states = [edits], [state]
        for layer in reversed(self.layers[1:]):
            _, _, state, edits = layer[state]
            parts.append(edits)
            states.append(state)
        rows, roles = [], []
        for row, (edits, before, after) in enumerate(zip(parts[::-1], states[::-1], [*states[-2::-1], states[0]], strict=True), 1):
            for e in edits:
                if e == "I":
                    before = ADDED[before]
                if e != "D":
                    rows.append(row if e in "KR" else 0)
                    roles.append("" if e == "K" else ROLES[before if e == "I" else after])
        return cost, "".join(reversed(parts)), rows, roles


def solve(words: DataFrame) -> DataFrame:
    """word, cost, audit, out_rows, out_roles of each distinct word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie()
        for b in batches:
            found = [trie.answer(w) for w in b["word"]]
            yield pd.DataFrame({"word": b["word"].to_numpy()} | {c: [f[k] for f in found] for k, c in enumerate(("cost", "audit", "out_rows", "out_roles"))})

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = words.select("word").distinct().repartitionByRange(parts, "word").sortWithinPartitions("word")
    return ordered.mapInPandas(run, "word string, cost long, audit string, out_rows array<int>, out_roles array<string>")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, copy) after damage that ``conv_id:turn`` decides; ``copy`` is null where the row is dropped."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id"), F.col("turn").cast("long"), told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(None).cast("int"))).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def intact(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the shape that ``repair`` takes."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", F.col("turn").cast("long"), told("role").alias("role"), told("text").alias("text"), F.lit(0).alias("copy"))


def diagnose(rows: DataFrame) -> DataFrame:
    """A row a conversation: its turns in order, its word, and counts of gaps, faults and illegal neighbours.

    One shuffle by conversation serves the order, the search for duplicates and the grouping.
    """
    there = F.col("copy").isNotNull()
    order = Window.partitionBy("conv_id").orderBy((~there).cast("int"), "turn", "role", "text", "copy")
    same = Window.partitionBy("conv_id", "there", "role", "text").orderBy("place")
    left = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(left == "", "blank").when(F.col("again") > 1, "duplicate").when(~F.substring(left, -1, 1).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    rows = rows.withColumn("there", there).withColumn("place", F.row_number().over(order)).withColumn("again", F.row_number().over(same))
    rows = rows.withColumn("fault", fault).withColumn("symbol", symbol)
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(there, F.struct("place", "turn", "role", "text", "fault", "symbol")))).alias("turns"))
    known = F.array_distinct(F.filter("turns.turn", lambda t: t.isNotNull()))
    count = lambda kind: F.size(F.filter("turns.fault", lambda f: f == kind)).cast("long").alias(kind)
    initials = F.transform("turns.role", lambda r: F.substring(r, 1, 1))
    pairs = F.zip_with(F.slice(initials, 1, F.greatest(F.size("turns") - 1, F.lit(0))), F.slice(initials, 2, F.greatest(F.size("turns") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return found.select(
        "conv_id", "turns", F.array_join("turns.symbol", "").alias("word"),
        F.coalesce(F.array_max(known) - F.array_min(known) + 1 - F.size(known), F.lit(0)).cast("long").alias("gaps"),
        count("blank"), count("duplicate"), count("truncated"), F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, the counts of ``diagnose``, cost, audit and ``repaired``: the turns (role, text) after the cheapest edits."""
    found = written(diagnose(rows), "repair-diagnosed")
    solved = written(solve(found), "repair-solved")
    made = F.zip_with("out_rows", "out_roles", lambda row, role: _turn(row, role))
    both = found.join(solved, "word")
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", made.alias("repaired"))


def _turn(row: Column, role: Column) -> Column:
    own = F.get(F.col("turns"), row - 1)
    return F.struct(F.when(role == "", own["role"]).otherwise(role).alias("role"), F.coalesce(own["text"], F.lit("")).alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """``repaired`` as the sha256 of its ``role:text`` lines."""
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return repaired.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")
