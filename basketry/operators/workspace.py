"""Documents that a client sends back, taken apart into changes of a workspace's tables.

A document is one JSON object for a workspace: ``products``, ``baskets``, ``basketItems`` (lists by basket id), ``cards``,
``offers``, ``connections`` and settings. What it does not name stays; a list that it names is the whole list, so what is absent
from it is deleted. Identifiers that the client made up are resolved to lasting ones, in every place that uses them:

* products of negative id are items of the common catalogue: the workspace's product of that name, or a new one, once a name;
  of other unknown ids, those with a name are new products. Known products stay as they are.
* baskets and cards of an id above zero keep it; others get new ids, in the document's order, after all ids in use.

Every layer of JSON is read alone, so what is malformed costs itself and no more: a document that is no object changes nothing,
an entry that is no object is left out, a number that cannot be read counts as missing. Of a product id that a document repeats the
first entry counts; of a basket id above zero, or a product in a basket, the last.

A version applies once: documents up to the last applied version of their workspace change nothing, so a batch may be replayed.
Several documents of a workspace apply one after another, in rounds over all workspaces; of one version the smallest counts. Rows
without a workspace or version are left out. Work is joins and windows by workspace, bounded by one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.session import tasks_for, written

#: Tables of the state; the first column of each is the workspace.
STATE = {
    "products": "workspace string, product_id long, name string, brand string, weight_g double, unit string, category string, active boolean",
    "baskets": "workspace string, basket_id long, name string, created_at string, source string",
    "items": "workspace string, basket_id long, product_id long, qty double, fallback_product_id long",
    "cards": "workspace string, card_id long, bank string, name string",
    "offers": "workspace string, offer_id long, card_id long, store_id long, percent double, cap_rub double, min_check_rub double, valid_from string, valid_to string, requires_activation boolean, activated boolean, cap_used double",
    "connections": "workspace string, chain string, device boolean",
    "settings": "workspace string, name string, value string",
    "applied": "workspace string, version long",
}
# Names that are shown where a client gives none, sources of a basket, settings a document may hold.
BASKET, BANK, CARD = "Корзина", "Банк", "Карта"
SOURCES = ("manual", "average", "history")
#: Letters of a document for each of its entries, about.
ENTRY = 32
SETTINGS = ("lastBasketId", "repeated", "address", "point", "storePerks", "applyBonuses")

State = dict[str, DataFrame]
Deal = Callable[[DataFrame], DataFrame]


def empty_state(spark: SparkSession) -> State:
    """Tables that the optimizer knows to be empty, so that joins with them go."""
    none = lambda schema: [F.lit(None).cast(c.dataType).alias(c.name) for c in StructType.fromDDL(schema)]
    return {name: spark.range(1).filter("false").select(*none(schema)) for name, schema in STATE.items()}


def _object(text: Column) -> Column:
    """A JSON object as a map of the raw texts of its values; null if it is none."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def _list(text: Column) -> Column:
    """A JSON list as the raw texts of its entries; null if it is none."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def _entries(docs: DataFrame, lists: Column) -> DataFrame:
    """One row for each object in a list of raw texts: what ``docs`` has, its place ``at`` and its values ``e``.

    An entry is read in a generator, so once: filters on what it holds would else read it again.
    """
    own = [c for c in ("workspace", "basket_id") if c in docs.columns]
    rows = docs.select(*own, F.posexplode(lists).alias("at", "text"))
    return rows.select(*own, "at", F.explode(F.array(_object(F.col("text")))).alias("e")).filter(F.col("e").isNotNull())


def _taken_apart(docs: DataFrame) -> DataFrame:
    """workspace, version and the lists, lists by key and settings of each document, read once for all tables; null where they are none."""
    body = docs.select("workspace", "version", F.explode(F.array(_object(F.col("document")))).alias("body"))
    part = F.col("body")
    listed = [_list(part[c]).alias(c) for c in ("products", "baskets", "cards", "offers")]
    keyed = [F.map_entries(_object(part[c])).alias(c) for c in ("basketItems", "connections")]
    settings = F.filter(F.map_entries(part), lambda x: x["key"].isin(*SETTINGS)).alias("settings")
    return body.select("workspace", "version", *listed, *keyed, settings)


def _long(c: Column) -> Column:
    return c.try_cast("double").try_cast("long")


def _text(c: Column, default: str | None = None) -> Column:
    trimmed = F.trim(c)
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(F.lit(default))


def _key(name: Column) -> Column:
    """Names are equal but for the case of A-Z."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _flag(c: Column, default: bool) -> Column:
    """A value that counts as true: all but false, nothing, zero and the empty text."""
    return F.when(c.isNull(), default).otherwise(~F.lower(c).isin("false", "0", "0.0", "", "[]", "{}"))


def _top(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy("workspace").agg(F.max(key).alias("top"))


def _numbered(rows: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """New ids in the document's order, after the largest one of the workspace."""
    place = F.row_number().over(Window.partitionBy("workspace").orderBy("at"))
    return rows.join(top, "workspace", "left").withColumn(key, F.greatest(F.coalesce("top", F.lit(0)), F.lit(0)) + place).drop("top")


def _products(state: State, docs: DataFrame, catalog: DataFrame, deal: Deal, size: int) -> tuple[DataFrame, DataFrame]:
    """The products after the documents, and (workspace, was, product_id) for ids that the client made up."""
    known, e = state["products"], F.col("e")
    rows = _entries(docs, F.col("products")).withColumn("id", _long(e["id"])).filter("id IS NOT NULL")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("workspace", "id").orderBy("at"))).filter("n = 1").drop("n")
    rows = rows.join(deal(known.select("workspace", F.col("product_id").alias("id"))).hint("merge"), ["workspace", "id"], "left_anti")
    base = catalog.select((-F.col("item_id")).alias("id"), F.struct("name", "brand", "weight_g", "unit", "category").alias("c"))
    rows = rows.join(base.filter("id < 0").dropDuplicates(["id"]).hint("merge"), "id", "left")
    unit = F.when((F.col("c.unit") == "kg") | (e["unit"] == "kg"), "kg").otherwise("pcs")
    rows = rows.select("workspace", "at", "id", F.coalesce(_text(F.col("c.name")), _text(e["name"])).alias("name"), F.coalesce(_text(F.col("c.brand")), e["brand"]).alias("brand"),
                       F.coalesce("c.weight_g", e["weight_g"].try_cast("double")).alias("weight_g"), unit.alias("unit"), F.coalesce(_text(F.col("c.category")), e["category"]).alias("category"),
                       ((F.col("id") < 0) | _flag(e["active"], True)).alias("active"), _key(F.coalesce(_text(F.col("c.name")), _text(e["name"]))).alias("key")).filter("name IS NOT NULL")
    named = deal(known).groupBy("workspace", _key(F.col("name")).alias("key")).agg(F.min("product_id").alias("found"))
    rows = deal(rows).join(named.hint("merge"), ["workspace", "key"], "left").withColumn("found", F.when(F.col("id") < 0, F.col("found")))
    # of new names the first row leads, and leaders are numbered in the document's order; the others have their leader's number
    fresh = F.col("found").isNull()
    rows = rows.join(_top(deal(known), "product_id").hint("merge"), "workspace", "left")
    first = F.min(F.when(fresh, F.col("at"))).over(Window.partitionBy("workspace", "key"))
    rows = rows.withColumn("lead", F.when(fresh, F.when(F.col("id") < 0, first).otherwise(F.col("at"))))
    place = F.sum(F.when(F.col("at") == F.col("lead"), 1).otherwise(0)).over(Window.partitionBy("workspace").orderBy("lead"))
    rows = rows.withColumn("product_id", F.when(fresh, F.greatest(F.coalesce("top", F.lit(0)), F.lit(0)) + place).otherwise(F.col("found")))
    rows = written(rows, "sync-named", size)
    return known.unionByName(rows.filter("at = lead").select(*known.columns)), rows.select("workspace", F.col("id").alias("was"), "product_id")


def _baskets(state: State, docs: DataFrame, today: str, deal: Deal) -> tuple[DataFrame, DataFrame]:
    """The baskets after the documents, and (workspace, was, basket_id) for every entry of a list."""
    known, e = state["baskets"], F.col("e")
    lists = docs.filter(F.col("baskets").isNotNull())
    rows = _entries(lists, F.col("baskets")).withColumn("was", F.coalesce(_long(e["id"]), F.lit(0)))
    rows = rows.select("workspace", "at", "was", _text(e["name"], BASKET).alias("name"), F.substring(_text(e["created_at"], today), 1, 19).alias("created_at"),
                       F.when(e["source"].isin(*SOURCES), e["source"]).otherwise(SOURCES[0]).alias("source"))
    last = F.row_number().over(Window.partitionBy("workspace", "was").orderBy(F.desc("at")))
    rows = rows.withColumn("last", last == 1).join(_top(deal(known), "basket_id").hint("merge"), "workspace", "left")
    kept = F.max(F.when(F.col("was") > 0, F.col("was"))).over(Window.partitionBy("workspace"))
    place = F.sum(F.when(F.col("was") <= 0, 1).otherwise(0)).over(Window.partitionBy("workspace").orderBy("at"))
    made = F.greatest("top", kept, F.lit(0)) + place
    after = rows.withColumn("basket_id", F.when(F.col("was") > 0, F.col("was")).otherwise(made)).filter("was <= 0 OR last").drop("top")
    after = written(after, "sync-listed")
    old = deal(known.select("workspace", "basket_id", F.col("created_at").alias("made_at")))
    whole = deal(after).join(old.hint("merge"), ["workspace", "basket_id"], "left").withColumn("created_at", F.coalesce("made_at", "created_at")).select(*known.columns)
    rest = deal(known).join(lists.select("workspace").hint("merge"), "workspace", "left_anti")
    return rest.unionByName(whole), after.filter("last").select("workspace", "was", "basket_id")


def _items(state: State, docs: DataFrame, products: DataFrame, product_ids: DataFrame, baskets: DataFrame, basket_ids: DataFrame, deal: Deal) -> DataFrame:
    known, e = state["items"], F.col("e")
    product_ids, basket_ids = deal(product_ids), deal(basket_ids)
    lists = docs.filter(F.col("baskets").isNotNull() & F.col("basketItems").isNotNull())
    named = lists.select("workspace", F.inline("basketItems").alias("was", "rows")).withColumn("was", F.col("was").try_cast("long"))
    named = named.join(basket_ids.hint("merge"), ["workspace", "was"]).select("workspace", "basket_id", "rows").dropDuplicates(["workspace", "basket_id"])
    rows = _entries(named, _list(F.col("rows"))).withColumns({"was": F.coalesce(_long(e["product_id"]), F.lit(0)), "qty": e["qty"].try_cast("double"), "fallback": _long(e["fallback_product_id"])})
    rows = rows.filter((F.col("qty") > 0) & ~F.isnan("qty")).join(product_ids.hint("merge"), ["workspace", "was"], "left")
    # an id that a document made up stands for a product of the workspace; any other has to be one itself
    valid = deal(products.select("workspace", "product_id")).distinct()
    rows = rows.join(valid.select("workspace", F.col("product_id").alias("was"), F.col("product_id").alias("own")).hint("merge"), ["workspace", "was"], "left")
    rows = rows.withColumn("product_id", F.coalesce("product_id", "own")).filter("product_id IS NOT NULL")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("workspace", "basket_id", "product_id").orderBy(F.desc("at")))).filter("n = 1")
    rows = rows.join(valid.select("workspace", F.col("product_id").alias("fallback"), F.col("product_id").alias("fallback_product_id")).hint("merge"), ["workspace", "fallback"], "left")
    rest = deal(known).join(deal(baskets.select("workspace", "basket_id")).hint("merge"), ["workspace", "basket_id"], "left_semi").join(named.select("workspace", "basket_id").hint("merge"), ["workspace", "basket_id"], "left_anti")
    return rest.select(*known.columns).unionByName(rows.select(*known.columns))


def _cards(state: State, docs: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards and offers: replaced as a whole where a document holds both lists."""
    e, cards, offers = F.col("e"), state["cards"], state["offers"]
    lists = docs.filter(F.col("cards").isNotNull() & F.col("offers").isNotNull())
    rows = _entries(lists, F.col("cards")).withColumn("was", F.coalesce(_long(e["id"]), F.lit(0)))
    rows = rows.withColumn("last", F.row_number().over(Window.partitionBy("workspace", "was").orderBy(F.desc("at"))) == 1)
    kept = rows.filter("was > 0 AND last").withColumn("card_id", F.col("was"))
    made = _numbered(rows.filter("was <= 0"), _top(cards.select("workspace", "card_id").union(kept.select("workspace", "card_id")), "card_id"), "card_id")
    after = kept.unionByName(made)
    ids = after.filter("last").select("workspace", "was", "card_id")
    new_cards = after.select("workspace", "card_id", _text(e["bank"], BANK).alias("bank"), _text(e["name"], CARD).alias("name"))
    rows = _entries(lists, F.col("offers")).withColumns({"was": F.coalesce(_long(e["card_id"]), F.lit(0)), "store_id": _long(e["store_id"])})
    rows = rows.join(ids, ["workspace", "was"]).join(stores.select("store_id").distinct(), "store_id", "left_semi")
    number = {c: F.coalesce(e[c].try_cast("double"), F.lit(0.0)) for c in ("percent", "cap_rub", "min_check_rub", "cap_used")}
    rows = _numbered(rows, _top(offers, "offer_id"), "offer_id").withColumns({**number, "valid_from": e["valid_from"], "valid_to": e["valid_to"], "requires_activation": _flag(e["requires_activation"], False), "activated": _flag(e["activated"], True)})
    rest = lambda t: t.join(lists.select("workspace"), "workspace", "left_anti")
    return rest(cards).unionByName(new_cards), rest(offers).unionByName(rows.select(*offers.columns))


def _connections(state: State, docs: DataFrame, chains: DataFrame) -> DataFrame:
    """Stores that a person is connected to: those a document names are connected or forgotten, the device stays as it was."""
    known = state["connections"]
    rows = docs.select("workspace", F.inline("connections").alias("chain", "e")).withColumn("e", _object(F.col("e"))).filter("e IS NOT NULL")
    rows = rows.join(chains.select("chain").distinct(), "chain", "left_semi")
    wanted = rows.select("workspace", "chain", _flag(F.col("e")["connected"], False).alias("want"), (F.coalesce(F.col("e")["mode"], F.lit("")) == "session").alias("as_device"))
    both = known.join(wanted, ["workspace", "chain"], "full")
    return both.filter(F.coalesce("want", F.lit(True))).select("workspace", "chain", F.coalesce("device", "as_device").alias("device"))


def _settings(state: State, docs: DataFrame, basket_ids: DataFrame) -> DataFrame:
    """Settings that a document names; null takes one away, and what is not of its form is passed over."""
    known = state["settings"]
    rows = docs.select("workspace", F.inline("settings").alias("name", "raw"))
    raw, name = F.col("raw"), F.col("name")
    rows = rows.withColumn("was", F.when(name == "lastBasketId", _long(raw))).join(basket_ids, ["workspace", "was"], "left")
    pair = _list(raw)
    value = (
        F.when(name == "lastBasketId", F.coalesce("basket_id", "was").cast("string"))
        .when(name.isin("repeated", "storePerks"), F.when(_object(raw).isNotNull(), raw))
        .when(name == "point", F.when((F.size(pair) == 2) & pair[0].try_cast("double").isNotNull() & pair[1].try_cast("double").isNotNull(), raw))
        .when(name == "applyBonuses", F.when(_flag(raw, False), "1").otherwise("0"))
        .otherwise(_text(raw))
    )
    rows = rows.select("workspace", "name", "raw", value.alias("value"))
    odd = F.col("raw").isNotNull() & F.col("value").isNull() & name.isin("lastBasketId", "point") | F.col("value").isNull() & (name == "storePerks")
    rows = rows.filter(~odd)
    return known.join(rows.select("workspace", "name"), ["workspace", "name"], "left_anti").select(*known.columns).unionByName(rows.filter("value IS NOT NULL").select(*known.columns))


def apply_documents(state: State, documents: DataFrame, catalog: DataFrame, stores: DataFrame, chains: DataFrame, today: str) -> State:
    """The state after the documents (workspace, version, document).

    ``catalog`` (item_id, name, brand, weight_g, unit, category) holds what negative product ids stand for, ``stores`` (store_id) and
    ``chains`` (chain) what offers and connections may name; ``today`` dates baskets without a date.
    """
    docs = documents.select(F.col("workspace").cast("string").alias("workspace"), F.col("version").cast("long").alias("version"), F.col("document").cast("string").alias("document"))
    docs = docs.filter("workspace IS NOT NULL AND version IS NOT NULL").join(state["applied"].groupBy("workspace").agg(F.max("version").alias("done")), "workspace", "left")
    docs = docs.filter("done IS NULL OR version > done").groupBy("workspace", "version").agg(F.min("document").alias("document"))
    docs = written(docs.withColumn("round", F.row_number().over(Window.partitionBy("workspace").orderBy("version"))), "sync-documents")
    rounds, letters = (x or 0 for x in docs.agg(F.max("round"), F.sum(F.length("document"))).first())
    # a workspace's rows lie together in every table, in as many tasks as the documents need: joins and windows by it move nothing
    size = letters // ENTRY
    n = tasks_for(docs.sparkSession, size)
    deal = lambda df: df.repartition(n, "workspace")
    for nth in range(1, rounds + 1):
        now = deal(written(_taken_apart(docs.filter(F.col("round") == nth)), "sync-bodies"))
        products, product_ids = _products(state, now, catalog, deal, size)
        baskets, basket_ids = _baskets(state, now, today, deal)
        # read by several tables each: written once, so their plans stay small
        products, baskets = written(products, "sync-products", size), written(baskets, "sync-baskets", size)
        items = _items(state, now, products, product_ids, baskets, basket_ids, deal)
        cards, offers = _cards(state, now, stores)
        applied = state["applied"].unionByName(now.select("workspace", "version")).groupBy("workspace").agg(F.max("version").alias("version"))
        after = {"items": items, "cards": cards, "offers": offers, "connections": _connections(state, now, chains), "settings": _settings(state, now, basket_ids), "applied": applied}
        state = {"products": products, "baskets": baskets, **{name: written(df, f"sync-{name}", size) for name, df in after.items()}}
    return state


def documents_of(state: State) -> DataFrame:
    """(workspace, document) of every workspace that has a row anywhere, in the form that :func:`apply_documents` reads."""

    def listed(name: str, id_name: str, as_name: str) -> DataFrame:
        columns = [F.col(id_name).alias("id"), *[c for c in state[name].columns if c not in ("workspace", id_name)]]
        return state[name].groupBy("workspace").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(as_name))

    lines = state["items"].groupBy("workspace", "basket_id").agg(F.array_sort(F.collect_list(F.struct("product_id", "qty", "fallback_product_id"))).alias("rows"))
    every = state["baskets"].select("workspace", "basket_id").join(lines, ["workspace", "basket_id"], "left")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("basket_id").cast("string").alias("k"), F.coalesce("rows", F.array().cast("array<struct<product_id:bigint,qty:double,fallback_product_id:bigint>>")).alias("v"))))
    parts = [listed("products", "product_id", "products"), listed("baskets", "basket_id", "baskets"), every.groupBy("workspace").agg(F.map_from_entries(pairs).alias("basketItems")), listed("cards", "card_id", "cards"), listed("offers", "offer_id", "offers")]
    open_now = F.struct(F.lit(True).alias("connected"), F.when(F.col("device"), "session").otherwise("account").alias("mode"))
    parts.append(state["connections"].groupBy("workspace").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chain", open_now.alias("v"))))).alias("connections")))
    held = {s: F.max(F.when(F.col("name") == s, F.col("value"))).alias(s) for s in SETTINGS}
    parts.append(state["settings"].groupBy("workspace").agg(*held.values()))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "workspace", "full")
    plain = [c for c in out.columns if c not in ("workspace", "repeated", "storePerks", "point", "applyBonuses")]
    nested = [_object(F.col("repeated")).alias("repeated"), _object(F.col("storePerks")).alias("storePerks"), F.from_json("point", "array<double>").alias("point"), (F.col("applyBonuses") == "1").alias("applyBonuses")]
    return out.select("workspace", F.to_json(F.struct(*plain, *nested)).alias("document"))
