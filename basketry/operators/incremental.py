"""Resolution of a catalogue that changes a little: only what a batch of changes can touch is compared again.

A :class:`Resolution` holds what a full run has found: prepared rows with their representatives, the word of each
representative that the index knows it by, the links by words, and components, items and permanent ids.
:func:`resolve_changes` takes the rows that are new or changed and the ids that are gone and gives the next one:

* Facts are read from the changed rows only. Where a brand word enters or leaves the whole catalogue's vocabulary, the rows
  that have this word count as changed as well.
* Representatives that are new, or first of their facts now, meet the others through the word index; links of those that
  are gone or no longer first are dropped. Links between others stay.
* Components that a changed row, a dropped or a new link touches are built again from the links inside them, so they may part as
  well as grow, and are cut again; all others keep their items and ids.

The result is that of a full run over the same rows with the same ids before. Tables of the state are scanned, but only rows
that the batch touches are shuffled, compared and cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import resolve
from basketry.session import written


@dataclass(frozen=True)
class Resolution:
    rows: DataFrame  # prepared rows with facts and rep
    index: DataFrame  # id, word of representatives
    links: DataFrame  # a, b: links by words between representatives
    items: DataFrame  # id, component, item, item_id

    def ids(self) -> DataFrame:
        return self.items.select("id", "item_id")


def resolve_all(catalog: DataFrame) -> Resolution:
    """A full run over a catalogue (id, chain, name, brand, weight_g, unit, barcode, item_id)."""
    rows = written(resolve.with_reps(resolve.prepare(resolve.spread(catalog, "id"))), "resolution-rows")
    reps = resolve.spread(rows.filter("id = rep").drop("facts", "rep"), "id")
    index = written(resolve.rare_words(reps), "resolution-index")
    links = written(resolve.word_links(reps, reps, index).select("a", "b").distinct(), "resolution-links")
    items = _items(rows, links, catalog.select("id", "item_id"), None)
    return Resolution(rows, index, links, written(items, "resolution-items"))


def _items(rows: DataFrame, links: DataFrame, before: DataFrame, top: int | None) -> DataFrame:
    """id, component, item, item_id of rows and all links between them."""
    pairs = [x.select("a", "b") for x in (resolve.coded_links(rows), resolve.copy_links(rows), links)]
    members = written(resolve.cluster(rows, pairs[0].unionByName(pairs[1]).unionByName(pairs[2])), "resolution-members")
    items = written(resolve.split_chained(rows, members), "resolution-parts")
    return items.join(members, "id").join(resolve.keep_ids(items, before, top), "item").select("id", "component", "item", "item_id")


def _having(rows: DataFrame, words: DataFrame, column: str = "fwords") -> DataFrame:
    """Ids of rows that have one of the words."""
    return rows.select("id", F.explode(column).alias("word")).join(words, "word", "left_semi").select("id").distinct()


def _said(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Those of the words that are in a brand of the rows."""
    return rows.select(F.explode("brand_words").alias("word")).join(words, "word", "left_semi").distinct()


def _of(column: str, *tables: DataFrame) -> DataFrame:
    """The distinct values of a column in any of the tables, written."""
    every = tables[0].select(column)
    for x in tables[1:]:
        every = every.unionByName(x.select(column))
    return written(every.distinct(), "batch")


def resolve_changes(state: Resolution, changed: DataFrame, removed: DataFrame) -> Resolution:
    """The resolution after ``changed`` rows (as in a catalogue; new ids, or new values of old ones) and ``removed`` ids."""
    old = state.rows
    fresh = written(resolve.facts_of(changed), "batch")
    gone = _of("id", fresh, removed)
    kept = old.join(gone, "id", "left_anti")
    stale = written(old.join(gone, "id", "left_semi"), "batch")

    # brand words that the vocabulary has gained or lost, and the rows that have them
    asked = written(stale.select(F.explode("brand_words").alias("word")).unionByName(fresh.select(F.explode("brand_words").alias("word"))).distinct(), "batch")
    now_said = kept.select("brand_words").unionByName(fresh.select("brand_words"))
    was, now = written(_said(old, asked), "batch"), written(_said(now_said, asked), "batch")
    flipped = written(was.join(now, "word", "left_anti").unionByName(now.join(was, "word", "left_anti")), "batch")
    touched = written(_having(kept, flipped), "batch")
    before = written(stale.unionByName(kept.join(touched, "id", "left_semi")), "batch")
    renewed = written(fresh.unionByName(kept.join(touched, "id", "left_semi").drop("known", "facts", "rep")), "batch")
    spoken = renewed.select(F.explode("fwords").alias("word")).distinct()
    dirty = written(resolve.knowing(renewed, _said(now_said, spoken)).withColumn("facts", F.xxhash64(*resolve.FACTS)), "batch")

    # first rows of the facts that have changed hands
    same = kept.join(touched, "id", "left_anti")
    classes = _of("facts", before, dirty)
    first = same.join(classes, "facts", "left_semi").select("id", "facts").unionByName(dirty.select("id", "facts")).groupBy("facts").agg(F.min("id").alias("first"))
    first = written(first, "batch")
    rows = same.join(first, "facts", "left").withColumn("rep", F.coalesce("first", "rep")).drop("first").unionByName(dirty.join(first.withColumnRenamed("first", "rep"), "facts"))
    rows = written(rows.select(*old.columns), "resolution-rows")
    were = old.filter("id = rep").join(classes, "facts", "left_semi").select("id")
    are = first.select(F.col("first").alias("id"))
    staying = written(were.join(are, "id", "left_semi").join(dirty.select("id"), "id", "left_anti"), "batch")
    lost, added = (written(x.join(staying, "id", "left_anti"), "batch") for x in (were, are))

    # links: without those of lost representatives, with those of added ones
    reps = rows.filter("id = rep").drop("facts", "rep")
    new = written(reps.join(added, "id", "left_semi"), "batch")
    index = written(state.index.join(lost, "id", "left_anti").unionByName(resolve.rare_words(new, reps)), "resolution-index")
    ends = [lost.withColumnRenamed("id", c) for c in "ab"]
    fewer = state.links.join(ends[0], "a", "left_anti").join(ends[1], "b", "left_anti")
    more = written(resolve.word_links(new, reps, index).select("a", "b").distinct(), "batch")
    links = written(fewer.unionByName(more).distinct(), "resolution-links")

    # components that any of this touches
    codes = _of("bkey", dirty.filter("bkey is not null"))
    told = rows.join(codes, "bkey", "left_semi").select("id").unionByName(rows.join(classes, "facts", "left_semi").select("id"))
    seeds = _of("id", gone, touched, told, more.select(F.col("a").alias("id")), more.select(F.col("b").alias("id")))
    parts = written(state.items.join(seeds, "id", "left_semi").select("component").distinct(), "batch")
    scope = _of("id", dirty, state.items.join(parts, "component", "left_semi").join(gone, "id", "left_anti"))
    inside = written(rows.join(scope, "id", "left_semi"), "batch")
    near = links.join(scope.withColumnRenamed("id", "a"), "a", "left_semi")
    ids = state.ids()
    top = ids.join(removed.select("id"), "id", "left_anti").agg(F.coalesce(F.max("item_id"), F.lit(0))).first()[0]
    again = _items(inside, near, ids.join(scope, "id", "left_semi"), top)
    untouched = state.items.join(parts, "component", "left_anti").join(gone, "id", "left_anti")
    return Resolution(rows, index, links, written(untouched.unionByName(again), "resolution-items"))
