"""Which listings of different chains are one item.

Rows are prepared once, brought together by a trusted barcode, by equal folded words, or by a rare word of the one whose
words the other holds (their first two folded words have to overlap), compared under guards and joined into components. Components are no items yet, as likeness does not carry
over: each is cut so that every member is the seed's product by itself and contradicts nothing that the group has gathered;
then barcode twins are gathered again where nothing of the group contradicts them. Rows with the same comparison facts are
compared once, through a representative, and only components of three or more representatives leave the JVM.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import text as t
from basketry.functions.prices import WEIGHT_TOLERANCE, weights_agree
from basketry.operators.graph import components
from basketry.operators.tiles import tiled_join, weight_class
from basketry.session import beside, in_buckets, written

# Words that name the usual kind of a product or are obligatory on a label; see ``same_product``.
DESCRIPTORS = (
    "пастеризованное пастеризованный пастеризованная питьевое питьевой питьевая отборное отборный отборная охлажденное "
    "охлажденный охлажденная цельное фильтрованное россия беларусь натуральное натуральный натуральная классическое "
    "классический классическая традиционное традиционный традиционная напиток"
).split()
SILENT_WORDS = "пэт pet тп тба бзмж беззмж безгмо без весов весовой весовая весовое весовые жб стб плб вкусом для".split() + t.SERVICE_WORDS
FACTS = ["unit", "weight_g", "packs", "pct", "pct_low", "marks", "brand_words", "known", "fwords", "numbers", "words", "bkey", "chain"]


def prepare(catalog: DataFrame) -> DataFrame:
    """id, chain and the comparison facts of catalogue rows (id, chain, name, brand, weight_g, unit, barcode)."""
    return with_known_brands(facts_of(catalog))


def facts_of(catalog: DataFrame) -> DataFrame:
    """What each row says by itself: all facts but the brands that other rows make known."""
    name = t.glue(F.col("name"))
    code = t.gtin(F.col("barcode"))
    noise = F.array(*[t.fold(F.lit(w)) for w in SILENT_WORDS])
    words = F.filter(t.ordered_words(F.concat_ws(" ", name, "brand")), lambda w: ~F.array_contains(noise, t.fold(w)))
    own_code = F.when(t.gtin_trusted(code), code).when(code.isNotNull(), F.concat_ws("#", "chain", code))
    return catalog.select(
        "id", "chain", "name", "unit", code.alias("gtin"), own_code.alias("bkey"),
        F.coalesce("weight_g", t.weight_g(F.col("name"))).alias("weight_g"), t.pack_count(F.col("name")).alias("packs"),
        t.parse_percent(F.col("name")).alias("pct"), t.parse_percent_low(F.col("name")).alias("pct_low"),
        t.variant_marks(F.col("name")).alias("marks"), t.name_numbers(F.col("name")).alias("numbers"),
        t.fold_words(t.ordered_words(F.col("brand"))).alias("brand_words"), F.array_sort(words).alias("words"),
        F.array_distinct(F.filter(F.transform(words, t.fold), lambda w: F.length(w) > 1)).alias("forder"), t.fold_words(words).alias("fwords"),
    )


def with_known_brands(rows: DataFrame) -> DataFrame:
    """``known``: those of a row's words that are a brand of any row of the catalogue."""
    rows = written(rows, "resolve-facts")  # read three times
    return knowing(rows, rows.select(F.explode("brand_words").alias("word")).distinct(), rows.count())


def knowing(rows: DataFrame, vocabulary: DataFrame, n: int = 0) -> DataFrame:
    """The rows with ``known``: those of their words that ``vocabulary`` (word) has."""
    spoken = rows.select(F.explode("fwords").alias("word")).distinct().join(vocabulary, "word", "left_semi")
    found = rows.select("id", F.explode("fwords").alias("word")).join(spoken, "word", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("known"))
    return rows.join(beside(found, n), "id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Dealt by ``key`` to as many tasks as the session shuffles to, however few bytes there are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _agree(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def compatible(a: str = "a", b: str = "b") -> Column:
    """Nothing that both state contradicts: unit, weight, packs, percent, numbers, marks, brand."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    weighed = lambda r: r("unit").eqNullSafe("kg") & r("weight_g").isNull()
    packed = lambda r: ~r("unit").eqNullSafe("kg") & r("weight_g").isNotNull()
    one_percent = x("pct").isNull() != y("pct").isNull()
    numbers = ~one_percent | (F.size(x("numbers")) == 0) | (F.size(y("numbers")) == 0) | F.arrays_overlap(x("numbers"), y("numbers"))
    brand = (F.size(x("brand_words")) == 0) | (F.size(y("brand_words")) == 0) | F.arrays_overlap(x("brand_words"), y("brand_words"))
    return (
        _agree(x("unit"), y("unit")) & ~(weighed(x) & packed(y)) & ~(weighed(y) & packed(x)) & weights_agree(x("weight_g"), y("weight_g"))
        & (x("packs") == y("packs")) & t.percents_agree(x("pct"), y("pct")) & t.percents_agree(x("pct_low"), y("pct_low"))
        & numbers & (x("marks") == y("marks")) & brand
    )


def same_product(a: str = "a", b: str = "b") -> Column:
    """struct ok, method, score. A barcode decides, with the piece-in-a-case exception; then words under the guards."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    extra = F.array(*[t.fold(F.lit(w)) for w in DESCRIPTORS])
    coded = (x("chain") == y("chain")) | ((F.length(x("bkey")) == 14) & (F.length(y("bkey")) == 14))
    coded = F.coalesce(coded & x("bkey").isNotNull() & y("bkey").isNotNull(), F.lit(False))
    same_code, same_load = x("bkey") == y("bkey"), t.item_payload(x("bkey")) == t.item_payload(y("bkey"))
    within = lambda p, q: F.size(F.array_except(p, q)) == 0
    inside = lambda c: within(x(c), y(c)) | within(y(c), x(c))
    more = F.array_union(F.array_except(x("fwords"), y("fwords")), F.array_except(y("fwords"), x("fwords")))
    some = (F.size(x("fwords")) > 0) & (F.size(y("fwords")) > 0)
    sized = x("weight_g").isNotNull() & y("weight_g").isNotNull()
    shared = F.array_intersect(x("fwords"), y("fwords"))  # of two lists, one inside the other: the shorter one
    branded = F.arrays_overlap(shared, F.concat(x("known"), y("known"), x("brand_words"), y("brand_words")))
    out = lambda ok, method, score: F.struct(F.lit(ok).alias("ok"), F.lit(method).alias("method"), score.alias("score"))
    sure = lambda high, low: F.when(sized, high).otherwise(low)
    return (
        F.when(coded & same_code, out(True, "barcode", F.lit(1.0)))
        .when(coded & ~same_load, out(False, "barcode", F.lit(0.0)))
        .when(~compatible(a, b) | ~some, out(False, "guard", F.lit(0.0)))
        .when(x("words") == y("words"), out(True, "words", sure(0.95, 0.8)))
        .when(inside("words") & sized & branded, out(True, "brand", F.lit(0.85)))
        .when(x("fwords") == y("fwords"), out(True, "folded", sure(0.9, 0.75)))
        .when(inside("fwords") & sized & branded & within(more, extra), out(True, "described", F.lit(0.8)))
        .otherwise(out(False, "words", F.lit(0.0)))
    )


class Fact:
    """A prepared row inside a Python worker, for components that have to be cut."""

    def __init__(self, r: dict, extra: frozenset[str]):
        self.r, self.extra = r, extra
        self.sets = {c: frozenset(r[c]) for c in ("words", "fwords", "marks", "brand_words", "known", "numbers")}
        self.number = {c: None if pd.isna(r[c]) else r[c] for c in ("weight_g", "pct", "pct_low", "packs")}
        self.unit, self.bkey, self.chain = (None if pd.isna(r[c]) else r[c] for c in ("unit", "bkey", "chain"))
        self.words, self.detail = list(r["words"]), (len(r["words"]), r["letters"])

    def trusted(self) -> bool:
        return self.bkey is not None and len(self.bkey) == 14

    def agrees(self, o: Fact) -> bool:
        """As :func:`compatible`."""
        far = lambda c, least: self.number[c] is not None and o.number[c] is not None and abs(self.number[c] - o.number[c]) >= least
        loose = [f.unit == "kg" and f.number["weight_g"] is None for f in (self, o)]
        packed = [f.unit != "kg" and f.number["weight_g"] is not None for f in (self, o)]
        w, v = self.number["weight_g"], o.number["weight_g"]
        return not (
            (self.unit and o.unit and self.unit != o.unit) or (loose[0] and packed[1]) or (loose[1] and packed[0])
            or (w is not None and v is not None and abs(w - v) > WEIGHT_TOLERANCE * max(w, v)) or self.number["packs"] != o.number["packs"]
            or far("pct", 0.05) or far("pct_low", 0.05) or self.numbers_clash(o) or self.sets["marks"] != o.sets["marks"]
            or (self.sets["brand_words"] and o.sets["brand_words"] and not self.sets["brand_words"] & o.sets["brand_words"])
        )

    def numbers_clash(self, o: Fact) -> bool:
        mine, other = self.sets["numbers"], o.sets["numbers"]
        return (self.number["pct"] is None) != (o.number["pct"] is None) and bool(mine) and bool(other) and not mine & other

    def is_product_of(self, o: Fact) -> bool:
        """As :func:`same_product`."""
        if self.bkey and o.bkey and (self.chain == o.chain or (self.trusted() and o.trusted())):
            if self.bkey == o.bkey:
                return True
            if self.bkey[1:13] != o.bkey[1:13]:
                return False
        words, folded = (self.sets["words"], o.sets["words"]), (self.sets["fwords"], o.sets["fwords"])
        if not folded[0] or not folded[1] or not self.agrees(o):
            return False
        if self.words == o.words or folded[0] == folded[1]:
            return True
        sized = self.number["weight_g"] is not None and o.number["weight_g"] is not None
        brands = self.sets["known"] | o.sets["known"] | self.sets["brand_words"] | o.sets["brand_words"]
        if not sized or not folded[0] & folded[1] & brands:
            return False
        inside = lambda p, q: p <= q or q <= p
        return inside(*words) or inside(*folded) and folded[0] ^ folded[1] <= self.extra


def cut_component(facts: list[Fact]) -> list[list[Fact]]:
    """Groups in which every member is the seed's product and contradicts no fact that the members before it have stated.

    The seed has the most words, then the longest name, then comes first. Twins by a trusted barcode that were parted are
    gathered where more of them are, unless a member there contradicts them.
    """
    groups, left = [], sorted(facts, key=lambda f: f.detail, reverse=True)
    while left:
        seed, rest = left[0], []
        group = [seed]
        stated = {c: seed.number[c] for c in ("pct", "pct_low")} | {"packs": seed.number["packs"] if seed.number["packs"] > 1 else None, "marks": seed.sets["marks"]}
        numbers = {(seed.number["pct"] is None, seed.sets["numbers"]): seed}
        for f in left[1:]:
            packs = f.number["packs"] if f.number["packs"] > 1 else None
            told = {c: f.number[c] for c in ("pct", "pct_low")} | {"packs": packs, "marks": f.sets["marks"]}
            apart = any(stated[c] is not None and told[c] is not None and abs(stated[c] - told[c]) >= 0.05 for c in ("pct", "pct_low"))
            apart |= any(bool(stated[c]) and bool(told[c]) and stated[c] != told[c] for c in ("packs", "marks"))
            if apart or any(f.numbers_clash(k) for k in numbers.values()) or not seed.is_product_of(f):
                rest.append(f)
                continue
            group.append(f)
            stated = {c: told[c] if stated[c] is None or c == "marks" and not stated[c] else stated[c] for c in stated}
            numbers.setdefault((f.number["pct"] is None, f.sets["numbers"]), f)
        groups.append(group)
        left = rest
    held: dict[str, Counter] = defaultdict(Counter)
    for n, group in enumerate(groups):
        for f in group:
            if f.trusted():
                held[f.bkey][n] += f.r["copies"]
    home = {code: min(at, key=lambda n: (-at[n], n)) for code, at in held.items() if len(at) > 1}
    now = [list(group) for group in groups]
    for n, group in enumerate(groups if home else []):
        for f in group:
            to = home.get(f.bkey, n)
            if to != n and all(f.agrees(o) for o in now[to]):
                now[n].remove(f)
                now[to].append(f)
    return [group for group in now if group]


def with_reps(rows: DataFrame, n: int = 0) -> DataFrame:
    """The rows with ``facts``, a hash of what is compared, and ``rep``, the first row that states the same."""
    keyed = rows.withColumn("facts", F.xxhash64(*FACTS))
    return keyed.join(beside(keyed.groupBy("facts").agg(F.min("id").alias("rep")), n), "facts")


def coded_links(rows: DataFrame, n: int = 0) -> DataFrame:
    """Links of rows with one barcode to the first of them."""
    coded = rows.filter("bkey is not null").select("id", "bkey")
    return coded.join(beside(coded.groupBy("bkey").agg(F.min("id").alias("a")), n), "bkey").filter("id <> a").select("a", F.col("id").alias("b"), F.lit("barcode").alias("method"), F.lit(1.0).alias("score"))


def copy_links(rows: DataFrame) -> DataFrame:
    """Links of rows (id, rep) to their representative."""
    return rows.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit("same").alias("method"), F.lit(1.0).alias("score"))


def rare_words(reps: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """id, word: of each representative's words the one that the fewest of ``every`` (by default themselves) have."""
    word = reps.select("id", F.explode("fwords").alias("word"))
    spoken = word if every is None else every.select(F.explode("fwords").alias("word")).join(word.select("word").distinct(), "word", "left_semi")
    return word.join(spoken.groupBy("word").count(), "word").groupBy("id").agg(F.min_by("word", F.struct("count", "word")).alias("word"))


def word_links(new: DataFrame, every: DataFrame, index: DataFrame, n: int = 0) -> DataFrame:
    """Links by words between representatives ``new``, about ``n``, and ``every`` (``new`` among them). index: id, word of ``every``.

    Whatever method links two rows by words, they agree in packs and marks, and either their folded words are equal or the one's hold all
    of the other's and both state weights that agree. So rows meet by all their words, or by one word of the smaller
    row (any would do; a rare one meets few) beside the class of the weight. Keys that stay hot are dealt to tiles.
    """
    apart = (F.col("a.chain") != F.col("b.chain")) | (F.col("a.bkey").isNotNull() & F.col("b.bkey").isNotNull())
    heads = F.arrays_overlap(F.slice("a.forder", 1, 2), F.slice("b.forder", 1, 2))
    as_one = lambda rows: rows.filter(F.size("fwords") > 0).withColumn("same", F.xxhash64("fwords", "packs", "marks"))
    found = _linked(tiled_join(as_one(new), as_one(every), ["same"], rows=n).filter(F.col("a.fwords") == F.col("b.fwords")), apart & heads)
    sized = lambda rows: rows.filter("weight_g is not null").withColumn("load", weight_class("weight_g")).withColumn("guard", F.xxhash64("packs", "marks"))
    near = F.explode(F.array(*[F.col("load") + k for k in (-1, 0, 1)]))
    held = lambda rows: sized(rows).withColumn("word", F.explode("fwords")).withColumn("load", near)
    smaller = F.size("a.fwords") < F.size("b.fwords")
    for inner, outer in [(new, every)] if new is every else [(new, every), (every, new)]:
        pairs = tiled_join(sized(inner).join(beside(index, n), "id"), held(outer), ["word", "load", "guard"], rows=n)
        found = found.unionByName(_linked(pairs.filter(smaller), apart & heads))
    return found.distinct()


def _linked(pairs: DataFrame, fit: Column) -> DataFrame:
    judged = pairs.filter((F.col("a.id") != F.col("b.id")) & fit).withColumn("s", same_product()).filter("s.ok")
    return judged.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), "s.method", "s.score")


def match_edges(rows: DataFrame) -> DataFrame:
    """Links (a, b, method, score) of prepared rows. Barcodes link to their first row, words through representatives."""
    n = rows.count()
    keyed = written(with_reps(rows, n), "resolve-rows", n)
    reps = spread(keyed.filter("id = rep").drop("facts", "rep"), "id")
    return coded_links(rows, n).unionByName(copy_links(keyed)).unionByName(word_links(reps, reps, rare_words(reps), keyed.filter("id = rep").count()))


def cluster(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component of every prepared row; rows without a link stand alone."""
    found = components(edges.select("a", "b"))
    return rows.select("id").join(beside(found.withColumnRenamed("node", "id"), found.count()), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def split_chained(rows: DataFrame, members: DataFrame) -> DataFrame:
    """id, item (its smallest id): components cut where members are not the seed's product; see :func:`cut_component`.

    Components of one or two kinds of rows are whole as they are. Of the others one representative of each kind travels.
    """
    extra = [r[0] for r in rows.sparkSession.range(1).select(F.explode(F.array(*[t.fold(F.lit(w)) for w in DESCRIPTORS]))).collect()]  # fixed words

    def cut(b: pd.DataFrame) -> list[tuple]:
        facts = [Fact(r, frozenset(extra)) for r in b.sort_values("id").to_dict("records")]
        return [(f.r["id"], min(o.r["id"] for o in group)) for group in cut_component(facts) for f in group]

    n = rows.count()
    placed = written(rows.select("id", "name", *FACTS).join(beside(members, n), "id").withColumn("facts", F.xxhash64(*FACTS)), "resolve-placed", n)
    kinds = placed.groupBy("component", "facts").agg(F.min("id").alias("rep"), F.max(F.length(F.coalesce("name", F.lit("")))).alias("letters"), F.count(F.lit(1)).alias("copies"))
    kinds = written(kinds, "resolve-kinds", n)
    n_kinds = kinds.count()
    big = kinds.groupBy("component").count().filter("count > 2").select("component")
    whole = placed.join(beside(big, n_kinds), "component", "left_anti").select("id", F.col("component").alias("item"))
    some = kinds.join(beside(big, n_kinds), "component", "left_semi").join(beside(placed.select(F.col("id").alias("rep"), *FACTS), n), "rep").withColumnRenamed("rep", "id")
    parts = written(in_buckets(written(some, "chained"), "component", cut, "id long, item long"), "resolve-parts")
    copies = placed.select("id", "component", "facts").join(beside(kinds.select("component", "facts", "rep"), n_kinds), ["component", "facts"])
    return whole.unionByName(copies.join(beside(parts.withColumnRenamed("id", "rep"), n_kinds), "rep").select("id", "item"))


def canonical(rows: DataFrame, items: DataFrame) -> DataFrame:
    """One record an item: a Cyrillic name before a Latin one, then most words, longest, smallest id; other facts by id."""
    r = rows.join(items, "id")
    rank = F.struct(F.col("name").rlike("[А-Яа-яЁё]").cast("int"), F.size("words"), F.length("name"), -F.col("id"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return r.groupBy("item").agg(F.max_by("name", rank).alias("name"), first("unit"), first("weight_g"), first("gtin"), F.count("id").alias("rows"), F.countDistinct("chain").alias("chains"))


def keep_ids(items: DataFrame, before: DataFrame, top: int | None = None) -> DataFrame:
    """item, item_id: every item keeps an old id by votes of its rows, each id once.

    Items and old ids that share votes, directly or through others, form a group; inside it the most votes go first, then
    the purest, then the larger item, then the smaller id. Items without votes get new ids after the highest
    (``top``, by default that of ``before``).
    """
    n = items.count()
    votes = items.join(beside(before.filter("item_id is not null").select("id", "item_id"), n), "id").groupBy("item", "item_id").agg(F.count("id").alias("votes"))
    size = items.groupBy("item").agg(F.count("id").alias("rows"))
    votes = written(votes.join(beside(size, n), "item"), "votes", n)
    edges = votes.select((F.col("item") * 2).alias("a"), (F.col("item_id") * 2 + 1).alias("b"))
    group = components(edges)

    def greedy(b: pd.DataFrame) -> list[tuple]:
        rows = sorted(zip(b["votes"], b["rows"], b["item_id"], b["item"], strict=True), key=lambda r: (-r[0], -r[0] / r[1], -r[1], r[2], r[3]))
        items_done, ids_done, out = set(), set(), []
        for _, _, item_id, item in rows:
            if item not in items_done and item_id not in ids_done:
                items_done.add(item)
                ids_done.add(item_id)
                out.append((item, item_id))
        return out

    kept = votes.join(beside(group.select((F.col("node") / 2).cast("long").alias("item"), "component", "node").filter("node % 2 = 0").drop("node"), n), "item")
    kept = written(in_buckets(written(kept, "vote-groups"), "component", greedy, "item long, item_id long"), "kept-ids")
    top = before.agg(F.coalesce(F.max("item_id"), F.lit(0))).first()[0] if top is None else top
    # new ids only have to be unique and stable for a run: the item's own row id is both
    fresh = size.join(beside(kept, n), "item", "left_anti").select("item", (F.col("item") + top + 1).alias("item_id"))
    return kept.unionByName(fresh)


def aliases(before: DataFrame, after: DataFrame) -> DataFrame:
    """old, new: ids that are gone point to where most of their rows went; of equal ones to the smaller id."""
    moved = before.filter("item_id is not null").select("id", F.col("item_id").alias("old")).join(after.select("id", F.col("item_id").alias("new")), "id")
    gone = moved.join(after.select(F.col("item_id").alias("old")).distinct(), "old", "left_anti")
    return gone.groupBy("old", "new").count().groupBy("old").agg(F.max_by("new", F.struct("count", -F.col("new"))).alias("new"))


def write_back(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The new snapshot with ``change``: inserted, updated (any column differs, nulls compared), same, or deleted."""
    o, n = before.alias("o"), after.alias("n")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    change = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNull(), "deleted").when(same, "same").otherwise("updated")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.coalesce(f"n.{c}", F.when(F.col(f"n.{key}").isNull(), F.col(f"o.{c}"))).alias(c) for c in columns], change.alias("change"))


def match_all(catalog: DataFrame) -> DataFrame:
    """id, item_id of a whole catalogue, keeping the ids that its rows had."""
    n = catalog.count()
    rows = written(prepare(spread(catalog, "id")), "prepared", n)
    items = written(split_chained(rows, cluster(rows, match_edges(rows))), "items", n)
    return items.join(beside(keep_ids(items, catalog.select("id", "item_id")), n), "item").select("id", "item_id")
