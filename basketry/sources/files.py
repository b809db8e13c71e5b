"""Tables from files: price lists, receipts, bundles. All of them give DataFrames with typed columns and count what they reject."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions.prices import off_by_hundred, parse_money, receipt_money

# Headers under which columns go.
HEADERS = {
    "name": ("name", "товар", "название", "наименование", "номенклатура", "продукт"),
    "price": ("price", "цена", "стоимость", "цена за единицу"),
    "qty": ("qty", "quantity", "количество", "кол-во", "колво"),
    "total": ("total", "sum", "сумма", "итого"),
    "date": ("date", "дата"),
    "store": ("store", "магазин", "сеть"),
    "unit": ("unit", "единица", "ед", "ед."),
    "sku": ("sku", "артикул", "код"),
}


# The same for receipts; a header that only has a word in it counts where none is the word.
RECEIPT_HEADERS = {
    "name": ("наименование", "название", "товар", "позиция", "продукт", "name", "item"),
    "qty": ("количество", "кол-во", "колво", "кол", "quantity", "qty", "amount"),
    "price": ("цена", "цена за единицу", "цена, ₽", "price", "unit_price"),
    "total": ("сумма", "стоимость", "итог", "total", "sum"),
    "date": ("дата", "date", "дата покупки"),
    "store": ("магазин", "store", "точка", "продавец"),
}


def _renamed(df: DataFrame, wanted: list[str]) -> DataFrame:
    low = {c.strip().lower().lstrip("﻿"): c for c in df.columns}
    found = {w: next((low[h] for h in HEADERS[w] if h in low), None) for w in wanted}
    return _chosen(df, found)


def _renamed_by_part(df: DataFrame, wanted: list[str]) -> DataFrame:
    at = pick_columns(df.columns, wanted)
    return _chosen(df, {w: None if i is None else df.columns[i] for w, i in at.items()})


def pick_columns(header: list[str], wanted: list[str]) -> dict[str, int | None]:
    """The place of each wanted column of a receipt: where a header is a known word, else where one has such a word in it."""
    low = [" ".join(c.lstrip("﻿").split()).lower() for c in header]
    whole = {w: [i for i, h in enumerate(low) if h in RECEIPT_HEADERS[w]] for w in wanted}
    part = {w: [i for i, h in enumerate(low) if any(word in h for word in RECEIPT_HEADERS[w])] for w in wanted}
    return {w: next(iter(whole[w] + part[w]), None) for w in wanted}


def _chosen(df: DataFrame, found: dict[str, str | None]) -> DataFrame:
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(w) for w, c in found.items()])


def separator(spark: SparkSession, path: str | list[str]) -> str:
    """Of semicolon, tab and comma the one that the first line has most of."""
    line = spark.read.text(path).limit(1).first()
    return max(";\t,", key=lambda s: (line[0].count(s) if line else 0)) if line else ","


def price_list(spark: SparkSession, path: str) -> DataFrame:
    """name, price of a price list in CSV; without known headers the first two columns."""
    sep = separator(spark, path)
    df = spark.read.csv(path, sep=sep, header=True)
    if not any(c.strip().lower().lstrip("﻿") in HEADERS["name"] for c in df.columns):
        df = spark.read.csv(path, sep=sep, header=False).select(F.col("_c0").alias("name"), F.col("_c1").alias("price"))
    out = _renamed(df, ["name", "price"])
    return out.select(F.trim("name").alias("name"), parse_money(F.col("price")).alias("price")).filter("name <> '' and price > 0")


def reference_prices(spark: SparkSession, path: str) -> DataFrame:
    """The reference price CSV: store_code, sku, name, price, unit, weight_g, price_per_kg, in_stock."""
    schema = "store_code string, sku string, name string, price string, unit string, weight_g string, price_per_kg string, in_stock string"
    df = spark.read.csv(path, header=True, schema=schema)
    yes = F.lower(F.trim(F.coalesce("in_stock", F.lit("1")))).isin("1", "true", "yes", "да", "y")
    return df.select("store_code", "sku", "name", "unit", *[parse_money(F.col(c)).alias(c) for c in ("price", "weight_g", "price_per_kg")], yes.alias("in_stock"))


RECEIPT = ["date", "store", "name", "qty", "price", "total"]
#: Fixed value: the encoding of tables that are no UTF-8.
OTHER_ENCODING = "cp1251"


def named_rows(files: DataFrame, read: Callable[[bytes], Iterator[list]], broken: tuple[type[Exception], ...] = ()) -> DataFrame:
    """path and the columns of a receipt, as text, of files (path, content) whose rows ``read`` gives; the first row names the columns.

    A file that breaks off with one of ``broken``, or that has no column for the name, has no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                out: list[tuple] = []
                at = None
                try:
                    for cells in read(content):
                        if at is None:
                            at = pick_columns([c or "" for c in cells], RECEIPT)
                        elif at["name"] is not None:
                            out.append((name, *[cells[i] if (i := at[c]) is not None and i < len(cells) else None for c in RECEIPT]))
                except broken:
                    out = []
                yield pd.DataFrame(out, columns=["path", *RECEIPT])

    return files.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{c} string" for c in RECEIPT))


def _other_rows(content: bytes) -> Iterator[list]:
    text = content.decode(OTHER_ENCODING, "replace")
    first = text.partition("\n")[0]
    return csv.reader(io.StringIO(text, newline=""), delimiter=max(";\t,", key=first.count))


def receipt_table(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """date, store, name, qty, price, total of receipt tables in CSV; price and total complete one another.

    Without an ``encoding`` each file is read in the one that it is in: those that are no valid UTF-8 in the other.
    """
    if encoding:
        return receipt_rows(_renamed_by_part(spark.read.csv(path, sep=separator(spark, path), header=True, encoding=encoding), RECEIPT))
    files = spark.read.format("binaryFile").load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    plain = [r["path"] for r in files.filter(valid).select("path").collect()]  # a row a file
    others = receipt_rows(named_rows(files.filter(~valid), _other_rows))
    if not plain:
        return others
    known = receipt_rows(_renamed_by_part(spark.read.csv(plain, sep=separator(spark, plain), header=True), RECEIPT))
    return known.unionByName(others)


def receipt_rows(raw: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Typed rows of a receipt from its text columns; rows without a name or a price go."""
    qty = F.coalesce(parse_money(F.col("qty")), F.lit(1.0))
    price, total, own = parse_money(F.col("price")), parse_money(F.col("total")), more or []
    out = raw.select(*own, parse_day(F.col("date")).alias("date"), "store", F.trim("name").alias("name"), qty.alias("qty"), price.alias("p"), total.alias("t"))
    return out.select(*own, "date", "store", "name", "qty", F.coalesce("p", F.round(F.try_divide("t", "qty"), 2)).alias("price"), F.coalesce("t", F.round(F.col("p") * F.col("qty"), 2)).alias("total")).filter("name <> '' and total is not null")


def parse_day(c: Column) -> Column:
    formats = ("yyyy-MM-dd", "dd.MM.yyyy", "dd.MM.yy", "yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy HH:mm")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


ITEM = "struct<name:string,quantity:double,price:string,sum:string>"
BUNDLE = f"struct<catalogue:array<struct<key:string,date:string,store:string,total:string>>,receipts:array<struct<key:string,fiscalData:struct<items:array<{ITEM}>>>>>"


def receipt_bundle(raw: DataFrame, column: str = "value") -> DataFrame:
    """key, date, store, position, name, qty, price, total of a JSON bundle; a receipt off by a hundred is put right by the list."""
    b = raw.select(F.from_json(column, BUNDLE).alias("b"))
    listed = b.select(F.explode("b.catalogue").alias("c")).select("c.key", parse_day(F.col("c.date")).alias("date"), "c.store", receipt_money(F.col("c.total")).alias("listed")).dropDuplicates(["key"])
    rows = b.select(F.explode("b.receipts").alias("r")).select("r.key", F.posexplode("r.fiscalData.items").alias("position", "i"))
    rows = rows.select("key", "position", F.trim("i.name").alias("name"), F.coalesce("i.quantity", F.lit(1.0)).alias("qty"), receipt_money(F.col("i.price")).alias("price"), receipt_money(F.col("i.sum")).alias("total")).filter("name <> ''")
    whole = F.sum("total").over(Window.partitionBy("key"))
    rows = rows.withColumn("whole", whole).join(listed, "key", "left")
    factor = F.coalesce(F.try_divide(off_by_hundred(F.col("whole"), F.col("listed")), F.col("whole")), F.lit(1.0))
    return rows.select("key", "date", "store", "position", "name", "qty", F.round(F.col("price") * factor, 2).alias("price"), F.round(F.col("total") * factor, 2).alias("total"))


def receipt_lines(raw: DataFrame, column: str = "text") -> DataFrame:
    """Plain receipt text, one "name qty x price = total" a line: the row's other columns, position, name, qty, price, total, declared.

    The declared total is that of the row's own text, found in it before its lines are parted, so no line is shuffled for it.
    """
    line = r"^\s*(.+?)\s+(\d+(?:[.,]\d+)?)\s*[xх*×]\s*(\d+(?:[.,]\d{1,2})?)\s*=\s*(\d+(?:[.,]\d{1,2})?)\s*$"
    total = r"(?iu)^\s*(?:итого?|всего|total)\s*[:=]?\s*(\d+(?:[.,]\d{1,2})?)\s*$"
    others = [c for c in raw.columns if c != column]
    said = F.transform(F.filter("_lines", lambda x: x.rlike(total)), lambda x: parse_money(F.nullif(F.regexp_extract(x, total, 1), F.lit(""))))
    texts = raw.select(*others, F.split(column, r"\r?\n").alias("_lines")).withColumn("declared", F.array_max(said))
    lines = texts.select(*others, "declared", F.posexplode("_lines").alias("position", "line")).filter(F.col("line").rlike(line))
    g = lambda i: F.nullif(F.regexp_extract("line", line, i), F.lit(""))
    return lines.select(*others, "position", g(1).alias("name"), *[parse_money(g(i)).alias(c) for i, c in ((2, "qty"), (3, "price"), (4, "total"))], "declared").filter("name is not null")


def pasted_lines(raw: DataFrame, column: str = "text") -> DataFrame:
    """Pasted "name; qty; price", "name; price" or "name price" lines: position, name, qty, price, and ok for what was understood.

    A line is parted once and its numbers are read once, in a generator: a filter on ``ok`` would else repeat all of it.
    """
    others = [c for c in raw.columns if c != column]
    lines = raw.select(*others, F.posexplode(F.split(column, r"\r?\n")).alias("position", "line")).filter(F.trim("line") != "")
    tail = r"^(.*?)\s+(\d+(?:[.,]\d{1,2})?)\s*(?:руб\.?|р\.?|₽)?$"
    lines = lines.withColumns({"_line": F.trim("line"), "_parts": F.split(F.replace("line", F.lit("\t"), F.lit(";")), ";")})
    three, two = F.size("_parts") >= 3, F.size("_parts") == 2
    at = lambda i: F.trim(F.get("_parts", F.lit(i - 1)))
    end = lambda i: F.regexp_extract("_line", tail, i)
    texts = F.struct(F.when(three | two, at(1)).otherwise(F.coalesce(F.nullif(end(1), F.lit("")), "_line")).alias("name"), F.when(three, at(2)).alias("qty"), F.when(three, at(3)).when(two, at(2)).otherwise(end(2)).alias("price"), three.alias("_three"))
    read = lines.select(*others, "position", F.inline(F.array(texts)))
    numbers = F.struct(F.when(F.col("_three"), parse_money(F.col("qty"))).otherwise(1.0).alias("qty"), parse_money(F.col("price")).alias("price"))
    out = read.select(*others, "position", "name", F.inline(F.array(numbers)))
    return out.withColumn("ok", (F.col("name") != "") & F.col("price").isNotNull() & F.col("qty").isNotNull())


def pasted_orders(raw: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Pasted shop orders, one product over several lines: the name gathers until a line of numbers ends it.

    key, position (of the number line), name, qty, price. A line of numbers is "2 шт 99,90 ₽" or "99,90".
    """
    number = r"(?iu)^\s*(?:(\d+(?:[.,]\d+)?)\s*(?:шт|кг|г|л|уп|x|х|×)\.?\s*)?(?:[x×х*]\s*)?(\d+(?:[.,]\d{1,2})?)\s*(?:руб\.?|р\.?|₽)\s*$"
    lines = raw.select(key, F.posexplode(F.split(column, r"\r?\n")).alias("position", "line")).filter(F.trim("line") != "")
    lines = lines.withColumn("ends", F.col("line").rlike(number))
    before = Window.partitionBy(key).orderBy("position")
    lines = lines.withColumn("group", F.sum(F.col("ends").cast("int")).over(before) - F.col("ends").cast("int"))
    g = F.array_sort(F.collect_list(F.when(~F.col("ends"), F.struct("position", F.trim("line").alias("line")))))
    out = lines.groupBy(key, "group").agg(F.array_join(F.transform(g, lambda x: x["line"]), " ").alias("name"), F.max(F.when(F.col("ends"), F.col("position"))).alias("position"), F.max(F.when(F.col("ends"), F.col("line"))).alias("tail"))
    qty = F.coalesce(parse_money(F.nullif(F.regexp_extract("tail", number, 1), F.lit(""))), F.lit(1.0))
    return out.filter("tail is not null and name <> ''").select(key, "position", "name", qty.alias("qty"), parse_money(F.regexp_extract("tail", number, 2)).alias("price"))


def price_bundle(raw: DataFrame, column: str = "value", most: int = 50_000) -> DataFrame:
    """Rows of a JSON price bundle {items: [{sku, name, price, ...}]}: position, fields, and why a row is skipped (null: it stays).

    A bundle of more than ``most`` items is refused whole: all its rows are skipped.
    """
    schema = "struct<items:array<struct<sku:string,name:string,price:string,unit:string,weight_g:double,in_stock:boolean>>>"
    rows = raw.select(F.from_json(column, schema)["items"].alias("items")).select(F.size("items").alias("n"), F.posexplode("items").alias("position", "i")).select("n", "position", "i.*").withColumn("price", parse_money(F.col("price")))
    bad = F.when(F.col("n") > most, "bundle too long").when(F.coalesce("sku", F.lit("")) == "", "no sku").when(F.coalesce("name", F.lit("")) == "", "no name").when(F.coalesce("price", F.lit(0.0)) <= 0, "no price")
    rows = rows.withColumn("skipped", bad).drop("n")
    nth = F.row_number().over(Window.partitionBy("sku", F.col("skipped").isNull()).orderBy("position"))
    return rows.withColumn("skipped", F.coalesce("skipped", F.when(nth > 1, "repeated")))


def fingerprint(date: Column, store: Column, total: Column, names: Column) -> Column:
    """First 16 hex digits of SHA-1 over a receipt's date, store, total and its rows in order."""
    return F.substring(F.sha1(F.concat_ws("|", date.cast("string"), F.coalesce(store, F.lit("")), F.format_string("%.2f", total.cast("double")), F.array_join(names, "|"))), 1, 16)


# Where operators of fiscal data put a receipt's shop and day, and an item's code.
SHOP_FIELDS = ("brand", "retailPlace", "user", "store", "retailPlaceAddress")
DAY_FIELDS = ("dateTime", "date", "createdDate", "receiveDate", "buyDate")
CODE_FIELDS = ("ean13", "barcode", "productCode", "rawProductCode", "gtin", "ean")
_code = re.compile(r"(?<!\d)(\d{12,14}|\d{8})(?!\d)")
RECEIPT_NODE = "struct<shops:array<string>,day:string,whole:double,items:array<struct<position:int,name:string,qty:double,price:double,total:double,barcode:string>>>"


def _with_items(node: object) -> dict | None:
    """The first object, in the order of the document, that holds a list of items. Without recursion, at any depth."""
    todo = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, dict):
            if isinstance(n.get("items"), list) and n["items"]:
                return n
            todo += reversed(list(n.values()))
        elif isinstance(n, list):
            todo += reversed(n)
    return None


def _number(v: object) -> float | None:
    m = re.search(r"-?\d+(?:\.\d+)?", re.sub(r"[\s ]", "", str(v)).replace(",", ".")) if v is not None and not isinstance(v, (bool, dict, list)) else None
    return float(m[0]) if m else None


def _rubles(v: object) -> float | None:
    """A whole number is kopecks, anything else is rubles."""
    n = _number(v)
    return None if n is None else round(n / 100 if isinstance(v, int) else n, 2)


def _item_code(item: dict) -> str | None:
    for at in (item, *(x for k in ("productCodeNew", "ProductCodeNew") if isinstance(item.get(k), dict) for x in item[k].values() if isinstance(x, dict))):
        for k in CODE_FIELDS:
            v = at.get(k) or at.get(k.capitalize())
            if isinstance(v, (str, int)) and (m := _code.search(str(v))):
                return m[1]
    return None


def _receipt_node(text: str | None) -> dict | None:
    try:
        node = _with_items(json.loads(text or "null"))
    except ValueError:
        return None
    if node is None:
        return None
    either = lambda i, k: i.get(k) if i.get(k) is not None else i.get(k.capitalize())
    items = []
    for position, i in enumerate(node["items"]):
        if not isinstance(i, dict):
            continue
        qty, price, total = _number(either(i, "quantity")) or 1.0, _rubles(either(i, "price")), _rubles(either(i, "sum"))
        price = round(total / qty, 2) if price is None and total is not None else price
        total = round(price * qty, 2) if total is None and price is not None else total
        if price is not None:
            items.append({"position": position, "name": str(either(i, "name") or "").strip(), "qty": qty, "price": price, "total": total, "barcode": _item_code(i)})
    whole = _rubles(node.get("totalSum", node.get("total")))
    shops = [s for k in SHOP_FIELDS if (s := str(node.get(k) or "").strip())]
    return {"shops": shops, "day": next((str(node[k]) for k in DAY_FIELDS if node.get(k)), None), "whole": whole, "items": items}


def receipt_documents(raw: DataFrame, column: str = "value", signs: list[tuple[str, str]] | None = None) -> DataFrame:
    """The row's other columns, date, store, whole, position, name, qty, price, total, barcode of receipts as JSON documents of any shape.

    A receipt is the first object with items, however deep it is nested. Its store is the first field that names a known chain (by
    ``signs``, see ``receipts.seller``), else the first that names anything; an item without a name is named by it. What is no JSON or has no priced item has no rows; ``whole`` is the
    sum of the items where the receipt does not state it.
    """
    from basketry.operators.receipts import seller

    read = F.pandas_udf(lambda texts: pd.DataFrame([_receipt_node(x) or {"shops": [], "day": None, "whole": None, "items": []} for x in texts], columns=["shops", "day", "whole", "items"]), RECEIPT_NODE)
    others = [c for c in raw.columns if c != column]
    r = raw.withColumn("_r", read(F.col(column)))
    shops = F.col("_r.shops")
    store = F.coalesce(F.get(F.filter(shops, lambda s: seller(s, signs or []).isNotNull()), F.lit(0)), F.get(shops, F.lit(0)))
    day = F.coalesce(parse_day(F.col("_r.day")), F.try_to_timestamp(F.regexp_extract("_r.day", r"\d{4}-\d{2}-\d{2}", 0), F.lit("yyyy-MM-dd")).cast("date"), F.try_to_timestamp(F.regexp_extract("_r.day", r"\d{2}\.\d{2}\.\d{4}", 0), F.lit("dd.MM.yyyy")).cast("date"))
    summed = F.round(F.aggregate("_r.items", F.lit(0.0), lambda s, i: s + i["total"]), 2)
    rows = r.select(*others, day.alias("date"), store.alias("store"), F.coalesce("_r.whole", summed).alias("whole"), F.explode("_r.items").alias("i"))
    return rows.select(*others, "date", "store", "whole", "i.position", F.coalesce(F.nullif("i.name", F.lit("")), "store", F.lit("Позиция без названия")).alias("name"), "i.qty", "i.price", "i.total", "i.barcode")
