"""Products from pages and addresses: URL rules, JSON-LD, card text, sitemaps, catalogue APIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions.prices import parse_money
from basketry.functions.text import slug_name
from basketry.session import written


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^(?:www|m)\.", "")


def sku_of(url: Column, rules: list[tuple[str, str]]) -> Column:
    """The first non-empty group of the rule (host, pattern) whose host the address belongs to."""
    own, out = host(url), F.lit(None).cast("string")
    for domain, pattern in reversed(rules):
        here = (own == domain) | own.endswith("." + domain)
        out = F.when(here, F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))).otherwise(out)
    return out


def name_of(url: Column) -> Column:
    """Words of the last part of the path that is no number."""
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p.rlike("[^0-9]"))
    return slug_name(F.try_url_decode(F.try_element_at(parts, F.lit(-1))))


LD = "struct<`@type`:string,name:string,sku:string,gtin13:string,brand:string,image:string,offers:string>"


def product_in_ld(pages: DataFrame, html: str = "html") -> DataFrame:
    """The first Product of a page's JSON-LD: name, sku, gtin, price, in_stock."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    ld = F.transform(scripts, lambda s: F.from_json(s, LD))
    one = F.try_element_at(F.filter(ld, lambda x: x["@type"] == "Product"), F.lit(1))
    out = pages.withColumn("ld", one)
    offer = F.col("ld.offers")
    return out.select("*", F.col("ld.name").alias("name"), F.col("ld.sku").alias("sku"), F.col("ld.gtin13").alias("gtin"),
                      parse_money(F.coalesce(F.get_json_object(offer, "$.price"), F.get_json_object(offer, "$.lowPrice"), F.get_json_object(offer, "$[0].price"))).alias("price"),
                      F.get_json_object(offer, "$.availability").endswith("InStock").alias("in_stock")).drop("ld")


def _first_tag(html: Column, attribute: str, values: str, tags: str = "[a-z][a-z0-9]*") -> Column:
    """The first opening tag with one of the values of an attribute, as written; empty if there is none."""
    return F.regexp_extract(html, rf"""(?is)<(?:{tags})(?=\s)[^>]*?\s{attribute}\s*=\s*(?:"(?:{values})"|'(?:{values})'|(?:{values})(?=[\s/>]))[^>]*>""", 0)


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's quoted or bare value, trimmed; empty if it is missing."""
    return F.trim(F.concat(*(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{form}", 1) for form in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)"))))


def product_in_microdata(pages: DataFrame, html: str = "html") -> DataFrame:
    """The product of a page's attributes: name, price, in_stock; all null without a price above zero.

    The first tag of ``itemprop`` price counts, else the product's or the page's price in ``meta``; a value is its ``content`` or
    ``value``. A product is in stock unless its availability says that it is out of stock or no longer made. A name in no
    attribute is the text up to the next tag. Null and empty pages have no product.
    """
    page = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    sources = [_first_tag(page, "itemprop", "price"), *(_first_tag(page, "property", p, "meta") for p in ("product:price:amount", "og:price:amount"))]
    prices = [parse_money(_attribute(tag, a)) for tag in sources for a in ("content", "value")]
    price = F.coalesce(*(F.when(p > 0, p) for p in prices))
    stock = _first_tag(page, "(?:itemprop|property)", "availability|og:availability")
    gone = F.concat_ws(" ", *(F.lower(_attribute(stock, a)) for a in ("href", "content", "value"))).rlike("outofstock|discontinued")
    tag = _first_tag(page, "(?:itemprop|property)", "name|og:title")
    after = F.when(tag != "", F.regexp_extract(F.substr(page, F.instr(page, tag) + F.length(tag)), r"^[^<]*", 0))
    name = F.coalesce(*(F.when(n != "", n) for n in (_attribute(tag, "content"), _attribute(tag, "value"), F.trim(F.regexp_replace(after, r"\s+", " ")))))
    known = price.isNotNull()
    return pages.select("*", F.when(known, name).alias("name"), price.alias("price"), F.when(known, ~gone).alias("in_stock"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def card_text(text: Column) -> Column:
    """struct name, price, old_price of a card's text: prices by their sign, the name before the first of them without badges."""
    prices = F.regexp_extract_all(text, F.lit(r"(\d[\d   ]*(?:[.,]\d{1,2})?)\s*(?:₽|руб)"), F.lit(1))
    name = F.regexp_replace(text, r"(?s)\d[\d   ]*(?:[.,]\d{1,2})?\s*(?:₽|руб).*$", "")
    for _ in range(6):
        name = F.regexp_replace(F.trim(name), r"(?iu)^(?:-?\d{1,2}\s*%|новинка|хит|акция|выгодно|скидка)\s*", "")
    values = F.transform(prices, parse_money)
    return F.struct(F.trim(name).alias("name"), F.array_min(values).alias("price"), F.when(F.size(values) > 1, F.array_max(values)).alias("old_price"))


def cart_total(lines: DataFrame, group: str, position: str = "position", line: str = "line") -> DataFrame:
    """The last total of a cart page, with delivery and discount lines from 12 lines above it to 6 below."""
    money = r"(\d[\d   ]*(?:[.,]\d{1,2})?)\s*(?:₽|руб)"
    total, sent, off = "итого|к оплате|total", "доставк|delivery", "скидк|discount"
    # most lines of a page name no sum: they go by plain searches, before any pattern and before rows move
    low = F.lower(line)
    told = lines.filter(F.col(line).contains("₽") | F.col(line).contains("руб")).filter(low.rlike(f"{total}|{sent}|{off}"))
    kind = lambda p: low.rlike(p)
    rows = told.select(group, F.col(position).alias("position"), parse_money(F.nullif(F.regexp_extract(line, money, 1), F.lit(""))).alias("value"), kind(total).alias("ends"), kind(sent).alias("sent"), kind(off).alias("off")).filter("value is not null")
    page = Window.partitionBy(group)
    rows = rows.filter(F.col(group).isNotNull()).withColumn("at", F.max(F.when(F.col("ends"), F.col("position"))).over(page))
    near = rows.filter(F.col("position").between(F.col("at") - 12, F.col("at") + 6))
    label = lambda c: F.max_by("value", F.when(F.col(c), F.col("position")))
    last = F.max_by("value", F.when(F.col("ends") & (F.col("position") == F.col("at")), F.col("position"))).alias("total")
    out = near.groupBy(group).agg(last, label("sent").alias("delivery"), label("off").alias("discount"))
    return out.select(group, "total", "delivery", "discount").filter(F.col("total").between(0, 10_000_000))


def sitemap_locations(xml: DataFrame, column: str = "value", pick: str = "") -> DataFrame:
    """Addresses of sitemap documents, those that match ``pick``."""
    locs = F.regexp_extract_all(column, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return xml.select(F.explode(locs).alias("url")).filter(F.col("url").rlike(pick) if pick else F.lit(True)).distinct()


def api_products(raw: DataFrame, schema: str, fields: dict[str, str], prices: list[str], column: str = "value") -> DataFrame:
    """Products of a catalogue API: fields by JSON path expression, the first positive of several prices."""
    j = raw.select(F.from_json(column, schema).alias("j"))
    first = F.coalesce(*[F.when(F.col(f"j.{p}") > 0, F.col(f"j.{p}").cast("double")) for p in prices])
    return j.select(*[F.expr(f"j.{e}").alias(n) for n, e in fields.items()], first.alias("price"))


def coupon_terms(text: Column) -> Column:
    """struct price, percent, off of a coupon's words."""
    g = lambda p: parse_money(F.nullif(F.regexp_extract(text, p, 1), F.lit("")))
    return F.struct(g(r"(?iu)за\s+(\d+(?:[.,]\d{1,2})?)\s*(?:₽|руб)").alias("price"), g(r"(\d{1,2}(?:[.,]\d)?)\s*%").alias("percent"), g(r"(?iu)(?:скидка|минус|−|-)\s*(\d+(?:[.,]\d{1,2})?)\s*(?:₽|руб)").alias("off"))


def category_leaves(edges: DataFrame) -> DataFrame:
    """Leaves of a category tree (id, parent, name) with their path of names, by joins a level at a time, however deep.

    A category on a cycle of parents, or below one, hangs from no root and is no leaf; a way never meets a category twice.
    """
    edges = written(edges.select("id", "parent", "name").distinct(), "categories")
    kids = edges.select(F.col("parent").alias("id")).distinct()
    level = edges.filter("parent is null").select("id", F.array("name").alias("path"), F.array("id").alias("seen"))
    out = level
    while True:  # no way back, so levels run out
        below = level.withColumnRenamed("id", "parent").join(edges, "parent").filter(~F.array_contains("seen", F.col("id")))
        level = written(below.select("id", F.array_append("path", F.col("name")).alias("path"), F.array_append("seen", F.col("id")).alias("seen")), "category-level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("id", "path").join(kids, "id", "left_anti")
