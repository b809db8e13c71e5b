"""Signs that two similar names are different products. A sign counts only where both names show it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions import text as t
from basketry.functions.prices import weight_ok

# Kinds of products and the words that name them; Latin words that are no brand.
TYPE_WORDS = {
    "молоко": "молоко молочко", "кисломолочное": "кефир ряженка простокваша айран снежок", "йогурт": "йогурт йогуртный биойогурт",
    "творог": "творог творожок творожный", "сметана": "сметана сметанный", "сливки": "сливки сливочный",
    "сыр": "сыр сырный моцарелла страчателла брынза фета сулугуни", "сырок": "сырок сырки", "масло": "масло",
    "мороженое": "мороженое пломбир эскимо рожок брикет", "сок": "сок нектар морс", "вода": "вода минеральная",
    "напиток": "напиток коктейль лимонад газированный", "пюре": "пюре", "каша": "каша кашка",
    "колбаса": "колбаса салями сервелат докторская сырокопченая", "сосиски": "сосиски сардельки шпикачки", "ветчина": "ветчина буженина карбонад",
    "икра": "икра", "рыба": "форель семга лосось горбуша скумбрия сельдь тунец треска", "мясо": "говядина свинина баранина фарш",
    "птица": "курица куриный индейка цыпленок окорочка", "яйцо": "яйцо яйца", "хлеб": "хлеб батон багет булка лаваш",
    "хлебцы": "хлебцы сухарики гренки", "печенье": "печенье пряники вафли крекер", "конфеты": "конфеты шоколад шоколадка мармелад зефир пастила",
    "чай": "чай", "кофе": "кофе капучино эспрессо", "крупа": "крупа гречка гречневая рис пшено перловка булгур овсянка",
    "макароны": "макароны спагетти паста вермишель лапша рожки", "мука": "мука", "сахар": "сахар", "соль": "соль",
    "консервы": "консервированные консервированный маринованные маринованный", "соус": "соус кетчуп майонез горчица аджика", "чипсы": "чипсы снеки",
    "орехи": "орехи миндаль фундук кешью арахис", "овощи": "огурцы помидоры томаты картофель морковь лук капуста перец баклажаны кабачки свекла",
    "фрукты": "яблоки груши бананы апельсины мандарины нектарины персики слива сливы виноград авокадо лимоны",
    "ягоды": "клубника малина черника голубика вишня черешня", "заморозка": "пельмени вареники блины наггетсы котлеты",
    "дезодорант": "дезодорант антиперспирант", "уход": "шампунь бальзам гель мыло крем",
}
NO_BRANDS = "kg ml pcs new fresh light classic original premium mini maxi extra gold plus pro max eco bio zero cream cheese milk juice water www com high protein".split()
PACK_TOLERANCE = 0.1


def product_type(name: Column) -> Column:
    """The kind that the first telling word of a raw name stands for."""
    low = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("ё"), F.lit("е"))
    kinds = F.map_from_arrays(F.array(*[F.lit(w) for ws in TYPE_WORDS.values() for w in ws.split()]), F.array(*[F.lit(k) for k, ws in TYPE_WORDS.items() for _ in ws.split()]))
    found = F.array_compact(F.transform(F.regexp_extract_all(low, F.lit("[а-яa-z]+"), F.lit(0)), lambda w: F.try_element_at(kinds, w)))
    return F.try_element_at(found, F.lit(1))


def brands(name: Column) -> Column:
    """Latin words of three letters or more: in Cyrillic catalogues nearly always the brand."""
    found = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z][a-z0-9]{2,}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: ~w.isin(NO_BRANDS))))


def type_conflict(a: Column, b: Column) -> Column:
    return F.coalesce(product_type(a) != product_type(b), F.lit(False))


def brand_conflict(a: Column, b: Column) -> Column:
    x, y = brands(a), brands(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def percent_conflict(a: Column, b: Column) -> Column:
    """Both state a percent and it differs; where one does, the numbers of both names have to be the same."""
    p, q = t.parse_percent(a), t.parse_percent(b)
    spoken = lambda n: F.array_sort(F.transform(F.regexp_extract_all(F.regexp_replace(F.lower(n), t.WEIGHT, " "), F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda x: F.translate(x, ",", ".")))
    x, y = spoken(a), spoken(b)
    one = p.isNull() != q.isNull()
    return F.when(p.isNotNull() & q.isNotNull(), F.abs(p - q) >= 0.05).when(one, (F.size(x) > 0) & (F.size(y) > 0) & (x != y)).otherwise(False)


def doubts(name: Column, weight: Column, other: Column, other_weight: Column) -> Column:
    """Kinds of objection to a candidate: type, brand, percent, weight; an empty array if there is none."""
    off = ~weight_ok(weight, F.coalesce(other_weight, t.weight_g(other)))
    return F.array_compact(F.array(F.when(type_conflict(name, other), "type"), F.when(brand_conflict(name, other), "brand"), F.when(percent_conflict(name, other), "percent"), F.when(off, "weight")))


def pack_fits(wanted: Column, got: Column, tolerance: float = PACK_TOLERANCE) -> Column:
    """Null where either pack is unknown."""
    return F.when((wanted > 0) & (got > 0), F.abs(got - wanted) / wanted <= tolerance)


def difference(wanted: Column, got: Column, wanted_pack: Column, got_pack: Column) -> Column:
    """In words: what is missing, what is extra, another pack, another percent; empty if nothing differs."""
    w, g = t.ordered_words(wanted), t.ordered_words(got)
    few = lambda words: F.array_join(F.slice(F.array_sort(words), 1, 4), ", ")
    missing, extra = F.array_except(w, g), F.array_except(g, w)
    p, q = t.parse_percent(wanted), t.parse_percent(got)
    return F.concat_ws(
        "; ",
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), few(missing))),
        F.when(F.size(extra) > 0, F.concat(F.lit("extra: "), few(extra))),
        F.when(~pack_fits(wanted_pack, got_pack), F.format_string("pack %d g for %d g", got_pack.cast("long"), wanted_pack.cast("long"))),
        F.when(~t.percents_agree(p, q), F.format_string("percent %.1f for %.1f", q, p)),
    )
