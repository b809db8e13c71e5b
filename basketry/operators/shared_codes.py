"""Codes that two chains of one group share: a person's products get the one code whose rows say the same.

Names are taken apart once a row. Product and row then meet by a brand word, the pieces of a package and the remaining
numbers, which all have to agree anyway; what the words have to say is decided on those pairs only.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import text as t
from basketry.operators.resolve import DESCRIPTORS, SILENT_WORDS
from basketry.session import written

# What is cut from names, in Cyrillic and in the Latin letters of addresses; words that tell no products
# apart; beginnings of words that only one of two names may have in the soft pass; brands for small children.
AGE = (
    r"(?iU)(?<![а-яёa-z])(?:с|s)\s*\d+(?:[.,]\d+)?\s*(?:мес\w*|mes\w*|лет|let|год\w*|god\w*)\.?"
    r"|(?<![а-яёa-z])(?:с|s)\s+(?:рождения|rozdenia|rozhdeniya)"
    r"|(?<![а-яёa-z])(?:детск|detsk)\w*|(?<![а-яёa-z])(?:для|dla)\s+(?:детей|detej)"
)
JUNK_HEAD = r"(?iu)^(?:\s*(?:-?\d+\s*%|%\s*от\s*\d+\s*шт\s*[\d,.]+|нет оценок|комбо\s*[\d,.]+))+\s*"
JUNK_TAIL = r"\s+\d[\d\s]*\s\d{2}\s*₽.*$"
APOSTROPHE = r"(?U)(?<=\w)['’`](?=\w)"
STILL = r"(?iU)без\s+газа|не\s*газированн\w*|bez\s+gaza|ne\s*gazirovann\w*"
SPARKLING = r"(?iU)(?:с\s+)?газом|газированн\w*|(?:s\s+)?gazom|gazirovann\w*"
SIZES = r"(?iu)\d+(?:[.,]\d+)?\s*(?:кг|г|гр|мл|л|kg|gr|g|ml|l)(?![а-яёa-z])|(?:0\s|\d+\s(?!1(?:l|kg)(?![a-z])))\d{1,3}(?:l|kg)(?![a-z])"
PACKS = r"(?iU)\d+\s*(?:шт|sht|st|пак\w*|pak\w*)(?![а-яёa-z])|\d+\s*[xх*]\s*\d+"
LATIN_DECIMAL = r"(?<!\d)(0|\d(?!\s1(?:l|kg)(?![a-z])))\s(\d{1,3})(l|kg)(?![a-z])"
NEUTRAL = "вкусом вкуса вкус ассортименте ассортимент какао".split()
SOFT = (
    "картофельн натуральн газированн замороженн охлажденн обогащенн бифидобактер витаминизированн сухая сухой питьев "
    "безалкогольн упаковк высшего сорта сорт"
).split()
BABY_BRANDS = "тема агуша фрутоняня спеленок gerber hipp малютка".split()
WEIGHT_STEP = 0.03
GENERIC_WORDS, GENERIC_HEADS = 400, 300


def spelt(word: Column) -> Column:
    """The folded form that both chains' spellings share."""
    w = F.replace(t.fold(word), F.lit("j"), F.lit("i"))
    return F.when(w == "cola", "kola").otherwise(w)


@cache
def _spelt(words: tuple[str, ...]) -> list[str]:
    return SparkSession.active().range(1).select(F.array(*[spelt(F.lit(w)) for w in words])).first()[0]  # fixed words


def _list(words: list[str]) -> Column:
    return F.lit(_spelt(tuple(words)))


def _same_start(a: Column, b: Column, n: Column) -> Column:
    return (F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))


def same_stem(a: Column, b: Column) -> Column:
    """One word in two endings: of four letters three agree, of longer words all but two, at least four."""
    n = F.least(F.length(a), F.length(b))
    return (a == b) | ((n >= 4) & _same_start(a, b, F.when(n == 4, 3).otherwise(F.greatest(F.lit(4), n - 2))))


def same_brand(a: Column, b: Column) -> Column:
    """Equal, or from five letters on all but the last one of the shorter."""
    n = F.least(F.length(a), F.length(b))
    return (a == b) | ((n >= 5) & _same_start(a, b, n - 1))


def covered(word: Column, words: Column) -> Column:
    return F.exists(words, lambda x: same_stem(word, x))


def _cleaned(name: Column) -> Column:
    s = F.regexp_replace(F.coalesce(name, F.lit("")), APOSTROPHE, "")
    s = F.regexp_replace(F.regexp_replace(s, JUNK_HEAD, ""), JUNK_TAIL, "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, AGE, " "), r"\s+", " "))


def _folded(name: Column) -> Column:
    """Words in order, each once, none of digits only."""
    noise = F.array(*[t.fold(F.lit(w)) for w in SILENT_WORDS])
    words = F.filter(F.transform(t.ordered_words(t.glue(name)), t.fold), lambda w: (F.length(w) > 1) & ~F.array_contains(noise, w))
    return F.array_distinct(F.filter(F.transform(words, spelt), lambda w: ~w.rlike(r"^\d+$")))


def brand_words(brand: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(brand, F.lit(""))), "['’`]", "")
    words = F.transform(F.regexp_extract_all(low, F.lit("[a-zа-яё0-9]+"), F.lit(0)), spelt)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$")))


def with_facts(df: DataFrame) -> DataFrame:
    """Rows (name, weight_g, unit) with ``baby``, ``gas``, ``words``, ``packs``, ``numbers`` and the weight that the name gives."""
    name = F.coalesce(F.col("name"), F.lit(""))
    gas = F.when(name.rlike(STILL), "no").when(name.rlike(SPARKLING), "yes")
    plain = F.regexp_replace(F.regexp_replace(name, STILL, " "), SPARKLING, " ")
    part = lambda i: F.nullif(F.regexp_extract(name, LATIN_DECIMAL, i), F.lit(""))
    decimal = F.concat_ws(".", part(1), part(2)).try_cast("double") * 1000
    numbers = F.regexp_replace(F.regexp_replace(F.lower(t.glue(_cleaned(plain))), SIZES, " "), PACKS, " ")
    return df.withColumns({
        "baby": name.rlike(AGE), "gas": gas, "words": _folded(_cleaned(plain)), "packs": t.pack_count(_cleaned(plain)),
        "numbers": F.array_join(F.array_sort(F.regexp_extract_all(numbers, F.lit(r"\d+"), F.lit(0))), ","),
        "weight_g": F.when(part(1).isNotNull(), decimal).otherwise(F.coalesce(F.when(F.col("weight_g") > 0, F.col("weight_g")), t.weight_g(plain))),
    })


def vocabulary(brands: DataFrame, rows: DataFrame) -> DataFrame:
    """word: brand words that are not among the rows' most frequent words and first words. Both lists are of fixed length."""
    top = lambda w, n: w.filter("word is not null").groupBy("word").count().orderBy(F.desc("count"), "word").limit(n).select("word")
    common = top(rows.select(F.explode("words").alias("word")), GENERIC_WORDS).union(top(rows.select(F.try_element_at("words", F.lit(1)).alias("word")), GENERIC_HEADS))
    return brands.select(F.explode(brand_words(F.col("brand"))).alias("word")).distinct().join(F.broadcast(common.distinct()), "word", "left_anti")


def same_brand_rows(products: DataFrame, rows: DataFrame) -> DataFrame:
    """product_id, row: products (product_id, brand_set) with the rows (row, words) that hold one of their brands."""
    block = F.when(F.length("word") >= 5, F.concat(F.lit("~"), F.substring("word", 1, 4))).otherwise(F.col("word"))
    asked = products.select(F.explode("brand_set").alias("word")).distinct().select(F.col("word").alias("brand_word"), block.alias("block"))
    spoken = rows.select(F.explode("words").alias("word")).distinct().select("word", block.alias("block"))
    meet = asked.join(spoken, "block").filter(same_brand(F.col("brand_word"), F.col("word"))).select("brand_word", "word")
    mine = products.select("product_id", "packs", "numbers", F.explode("brand_set").alias("brand_word")).join(meet, "brand_word")
    theirs = rows.select("row", "packs", "numbers", F.explode("words").alias("word"))
    return mine.join(theirs, ["word", "packs", "numbers"]).select("product_id", "row").distinct()


def verdict(e: str, c: str) -> Column:
    """0: contradicts, 1: agrees but for words that may be missing, 2: agrees. ``e`` is a name of the product, ``c`` a row."""
    x, y, brands = (lambda f: F.col(f"{e}.{f}")), (lambda f: F.col(f"{c}.{f}")), F.col("brand_set")
    known = x("weight_g").isNotNull() & y("weight_g").isNotNull()
    sized = F.when(known, ~_apart(x("weight_g"), y("weight_g"))).otherwise((x("unit").eqNullSafe("kg") & y("unit").eqNullSafe("kg")) | ((x("packs") == y("packs")) & (x("packs") > 1)))
    branded = F.exists(brands, lambda b: F.exists(y("words"), lambda w: same_brand(b, w)))
    head = F.try_element_at(F.filter(y("words"), lambda w: ~F.array_contains(brands, w)), F.lit(1))
    telling = lambda words: F.filter(words, lambda w: _tells(w, brands))
    missing = F.exists(telling(x("words")), lambda w: ~covered(w, y("words")))
    extra = F.filter(telling(y("words")), lambda w: ~covered(w, x("words")))
    told = F.filter(extra, lambda w: ~F.exists(_list(SOFT), lambda s: w.startswith(s)))
    fits = ~_gas_apart(x("gas"), y("gas")) & sized & (x("packs") == y("packs")) & (x("numbers") == y("numbers")) & branded & F.coalesce(covered(head, x("words")), F.lit(False)) & ~missing
    return F.when(fits & (F.size(extra) == 0), 2).when(fits & (F.size(told) == 0), 1).otherwise(0)


def _apart(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) > WEIGHT_STEP * F.greatest(a, b), F.lit(False))


def _gas_apart(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def _tells(word: Column, brands: Column) -> Column:
    return (F.length(word) >= 3) & ~F.array_contains(_list(DESCRIPTORS[:-1] + SILENT_WORDS + NEUTRAL), word) & ~covered(word, brands)


def match_shared_codes(products: DataFrame, names: DataFrame, catalog: DataFrame, brands: DataFrame) -> DataFrame:
    """product_id, sku, soft: the only code that a product's names agree with; ``soft`` where they do but for words that
    one side may leave out. Products that fit none or several are not there: ambiguity is never a guess.

    products: product_id, brand, weight_g, unit; names: product_id, name, own (a receipt's or the person's, not another
    chain's); catalog: sku, name, weight_g, unit; brands: brand. Every word is indexed, frequent ones too. Products without
    a brand word of three letters fit none; null or empty names say nothing.
    """
    rows = catalog.filter("sku is not null and trim(coalesce(name, '')) <> ''").select("sku", "name", F.col("weight_g").cast("double").alias("weight_g"), "unit").distinct()
    rows = written(with_facts(rows).withColumn("row", F.xxhash64("sku", "name", "weight_g", "unit")), "codes-rows")
    p = products.select("product_id", "brand", F.col("weight_g").cast("double").alias("stored"), "unit")
    said = names.filter("trim(coalesce(name, '')) <> ''").groupBy("product_id", "name").agg(F.max("own").alias("own")).join(p, "product_id")
    said = with_facts(said.withColumn("weight_g", F.lit(None).cast("double"))).withColumn("weight_g", F.coalesce("weight_g", F.when(F.col("stored") > 0, F.col("stored"))))
    said = written(said.drop("stored"), "codes-names")
    listed = vocabulary(brands, rows)
    spoken = said.select("product_id", F.explode("words").alias("word")).join(listed, "word", "left_semi")
    stated = p.select("product_id", F.explode(brand_words(F.col("brand"))).alias("word"))
    sets = spoken.unionByName(stated).filter(F.length("word") >= 3).groupBy("product_id").agg(F.collect_set("word").alias("brand_set"))
    said = said.join(sets, "product_id")
    fact = ["gas", "weight_g", "packs", "numbers", "words", "unit", "baby", "own"]
    each = said.groupBy("product_id", "brand_set").agg(F.collect_list(F.struct(*fact)).alias("evs"))
    baby = F.exists("evs", lambda e: e["baby"]) | F.arrays_overlap("brand_set", _list(BABY_BRANDS))
    each = written(each.withColumn("for_baby", baby), "codes-products")
    meet = same_brand_rows(each.select("product_id", "brand_set", F.explode("evs").alias("e")).select("product_id", "brand_set", "e.packs", "e.numbers"), rows)
    pairs = meet.join(each, "product_id").join(rows.select("row", "sku", F.struct(*fact[:-1]).alias("c")), "row")
    own = F.filter("evs", lambda e: e["own"])
    c = lambda f: F.col(f"c.{f}")
    against = F.exists(own, lambda o: _apart(o["weight_g"], c("weight_g")) | _gas_apart(o["gas"], c("gas")) | ((o["numbers"] != "") & (c("numbers") != "") & (o["numbers"] != c("numbers"))))
    found = lambda w: F.exists(c("words"), lambda x: x.startswith(w) | same_stem(w, x))
    told = F.exists(own, lambda o: F.forall(o["words"], lambda w: ~_tells(w, F.col("brand_set")) | found(w)))
    same_age = F.col("for_baby") == (c("baby") | F.arrays_overlap("brand_set", _list(BABY_BRANDS)))
    kept = pairs.filter(same_age & ~against & told)
    judged = kept.select("product_id", "row", "sku", "brand_set", "c", F.explode("evs").alias("e")).withColumn("level", verdict("e", "c")).filter("level > 0")
    best = judged.groupBy("product_id", "sku").agg(F.max("level").alias("level"))
    top = best.groupBy("product_id").agg(*[f(F.when(F.col("level") == n, F.col("sku"))).alias(a) for n, k in ((2, "strict"), (1, "loose")) for f, a in ((F.count, f"n_{k}"), (F.min, k))])
    return top.select("product_id", F.when(F.col("n_strict") == 1, F.col("strict")).when((F.col("n_strict") == 0) & (F.col("n_loose") == 1), F.col("loose")).alias("sku"), (F.col("n_strict") == 0).alias("soft")).filter("sku is not null")
