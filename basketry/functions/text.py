"""Product-name expressions: everything stays a column of built-in functions.

Java's ``\\w`` and ``\\b`` are ASCII by default, so letters are spelt out or ``(?U)`` is given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of receipts and shelves that tell nothing about a product.
NOISE_WORDS = (
    "вк пол тм ип ооо зао оао ао шт уп упак упаковка пак пакет ед кор бут вес весовой весовая нов новинка акция "
    "сыр мяг мягк мягкий мягкая"
).split()
SERVICE_WORDS = "со из на по до от за во об при под над".split()
KEPT_UNITS = "г кг мл л шт".split()
VARIANT_MARKS = (
    "безглютена глютенфри glutenfree безлактозы безлактозный безсахара zero зеро light лайт легкий обезжиренный "
    "обезжиренное цельнозерновой цельнозерновые органический organic"
).split()
TRANSLIT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h",
    "ц": "c", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
FOLD_FROM, FOLD_TO = "абвгдеёжзийклмнопрстуфхцчшщыэюяъь", "abvgdeezziiklmnoprstufhccssieua"
FOLD_DIGRAPHS = (("shch", "s"), ("sch", "s"), ("ch", "c"), ("sh", "s"), ("zh", "z"), ("kh", "h"), ("ts", "c"), ("yu", "u"), ("ya", "a"), ("ye", "e"), ("yo", "e"), ("x", "ks"))

# Patterns of sizes, percents, weighed goods and digits that say nothing.
WEIGHT = r"(\d+(?:[.,]\d+)?)\s*(кг|kg|гр|мл|ml|г|g|л|l)(?![а-яa-z])"
PERCENT = r"(\d{1,2}(?:[.,]\d)?)\s*%"
PERCENT_RANGE = r"(?<!\d)(?<!\d[.,])(\d{1,2}(?:[.,]\d)?)\s*(?:%\s*)?[-–—]\s*(\d{1,2}(?:[.,]\d)?)\s*%"
WEIGHED = r"(?U)\bвесов\w*|\bразвес\w*|\bна\s+вес\b|\bвес\b|(?<![а-яa-z])кг(?![а-яa-z])"
# A digit alone that neither counts nor measures anything and is no number of a series.
BARE_DIGIT = (
    r"(?U)(?<![\w.,])(?<!(?:№|no|n)\s{0,3}\.?\s{0,3})\d(?![\w.,])"
    r"(?!\s*(?:%|шт|штук|уп|упак|пач|пакет|пакетик|капсул|саше|стик|таблет|злак|месяц|мес\b|дн\b|порци|кусоч|ломтик|сло|лист|рулон"
    r"|секци|предмет|доз|категор|сорт|см|мм|км|м\b|вт|гц|ма[хч]))(?!\s*[\d.,])(?!\s*(?:в|in|v)\s*-?\s*\d)"
)


def _low(c: Column) -> Column:
    return F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е"))


def _num(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def weight_g(name: Column) -> Column:
    """Grams or millilitres of the last size that a name states, null if none."""
    all_of = lambda group: F.regexp_extract_all(_low(name), F.lit(WEIGHT), F.lit(group))
    unit = F.try_element_at(all_of(2), F.lit(-1))
    value = _num(F.try_element_at(all_of(1), F.lit(-1)))
    return F.round(value * F.when(unit.isin("кг", "kg", "л", "l"), 1000.0).otherwise(1.0), 3)


def sold_by_weight(name: Column) -> Column:
    """The name says so with a word; a stated size is no such word."""
    return F.regexp_replace(_low(name), WEIGHT, " ").rlike(WEIGHED)


def unit_from_name(name: Column) -> Column:
    return F.when(sold_by_weight(name), "kg").when(weight_g(name) > 0, "pcs")


def _plain(value: Column) -> Column:
    whole = value == F.floor(value)
    return F.when(whole, F.floor(value).cast("string")).otherwise(F.round(value, 3).cast("string"))


def normalize_name(name: Column) -> Column:
    """Comparable form: vendor prefix, punctuation, noise and service words go; the last size comes back at the end."""
    s = F.regexp_replace(F.trim(_low(name)), r"^[а-яa-z]{1,4}(?:[/\\][а-яa-z]{1,4})*\.", " ")
    grams = weight_g(s)
    s = F.regexp_replace(F.regexp_replace(s, WEIGHT, " "), BARE_DIGIT, " ")
    s = F.regexp_replace(s, r"[^0-9a-zа-я]+", " ")
    words = F.filter(
        F.split(F.trim(s), " +"),
        lambda w: (w != "") & ~w.isin(NOISE_WORDS + SERVICE_WORDS) & ((F.length(w) > 1) | w.isin(KEPT_UNITS) | w.rlike(r"^\d$")),
    )
    size = F.when(grams >= 1000, F.concat(_plain(grams / 1000), F.lit(" кг"))).when(grams.isNotNull(), F.concat(_plain(grams), F.lit(" г")))
    return F.trim(F.concat_ws(" ", F.array_join(words, " "), size))


def ordered_words(name: Column) -> Column:
    """Telling words in the order of the name: no numbers, units or single letters, each once."""
    return F.array_distinct(F.filter(F.split(normalize_name(name), " "), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d") & ~w.isin("кг", "мл", "шт")))


def gtin(code: Column) -> Column:
    """One 14-digit key for EAN-8, UPC-A, EAN-13 and GTIN-14; null for anything else."""
    digits = F.regexp_replace(code.cast("string"), r"\D", "")
    return F.when(F.length(digits).isin(8, 12, 13, 14) & digits.rlike("[1-9]"), F.lpad(digits, 14, "0"))


def gtin_trusted(code: Column) -> Column:
    """The check digit holds and the prefix is no shop's own."""
    digit = lambda i: F.substring(code, i, 1).try_cast("int")
    total = reduce(lambda a, b: a + b, [digit(i) * (3 if i % 2 else 1) for i in range(1, 14)])
    sums = F.pmod(F.lit(10) - total % 10, F.lit(10)) == digit(14)
    ean8 = code.startswith("000000")
    own = F.when(ean8, F.substring(code, 7, 1).isin("0", "2")).when(
        code.startswith("0"), F.substring(code, 2, 1).eqNullSafe("2") | F.substring(code, 2, 2).isin("02", "04", "05", "98", "99")
    )
    return F.coalesce(code.rlike(r"^\d{14}$") & sums & ~F.coalesce(own, F.lit(False)), F.lit(False))


def item_payload(code: Column) -> Column:
    """Digits 2-13: a case and its piece agree in them."""
    return F.substring(code, 2, 12)


def translit(name: Column) -> Column:
    s = F.replace(F.replace(_low(name), F.lit("кс"), F.lit("x")), F.lit("дж"), F.lit("g"))
    one = {k: v for k, v in TRANSLIT.items() if len(v) < 2}
    for k, v in TRANSLIT.items():
        if len(v) > 1:
            s = F.replace(s, F.lit(k), F.lit(v))
    gone = [k for k, v in one.items() if not v]
    kept = [k for k, v in one.items() if v]
    return F.translate(s, "".join(kept + gone), "".join(one[k] for k in kept))


def fold(word: Column) -> Column:
    """Common short form in which Cyrillic and Latin spellings of a word meet."""
    s = F.translate(F.lower(F.coalesce(word, F.lit(""))), FOLD_FROM, FOLD_TO)
    for pair, short in FOLD_DIGRAPHS:
        s = F.replace(s, F.lit(pair), F.lit(short))
    s = F.replace(s, F.lit("y"), F.lit("i"))
    return F.replace(F.replace(s, F.lit("jj"), F.lit("i")), F.lit("j"), F.lit("i"))


def fold_words(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, fold), lambda w: F.length(w) > 1)))


# How names state the pieces of a package, first the multiplier with a unit, then pieces by word, containers
# before and after the number, a bare multiplier, rolls; names without Cyrillic letters are addresses in Latin letters.
_UNIT_AFTER = r"\s*(?:г|гр|кг|мл|л|шт|g|gr|kg|ml|l|sht)(?![а-яёa-z])"
_NOT_SIZE = r"(?!\d|[.,]\d|\s*[xх×*]\s*\d|\s*(?:см|мм|м|cm|mm|sm|m)(?![\p{L}\d_]))"
_PACK_NUMBER = r"(?!\d|[.,]\d)(?!\s*(?:г|гр|кг|мг|мл|л|шт|см|мм|м|%|g|gr|kg|ml|l)(?![а-яёa-z]))"
_TIMES_LATIN = r"(?:\s*kh\s*|h|\s+h\s+|\s*[x*]\s*)"
_CASE_LATIN = "upakovka|upak|up|korobka|kor|pak|blok|but(?:yl(?:ok|ki|ka))?|ban(?:ok|ki|ka)?|pach(?:ek|ki|ka)"
_IN_ONE = r"(?U)(?:(?<![\d.,])\d{1,2}|\ball|\bвсе|\bвсё)\s*-?\s*(?:в|in|v)\s*-?\s*1(?![\d.,])"
_PIECES = (
    r"(?<![\d.,])(\d{1,3})\s*(?:шт|пак(?:етик(?:ов|а|и)?|ет(?:ов|а|ы)?)?|капсул|саше|стик(?:ов|а|и)?|пирамид(?:ок|ки|ка)?|таблет(?:ок|ки|ка)?)\.?(?![а-яё])",
    r"(?<![\d.,])(\d{1,3})\s*(?:sht|st(?!\s*b\b)|paketikov|paketika|pak|kapsul|sashe|sase|stikov|piramidok|tabletok)(?![a-z])",
)
_PACKS = (
    [
        r"(?<![\d.,])(\d{1,3})\s*[xх×*]\s*\d+(?:[.,]\d+)?" + _UNIT_AFTER,
        r"[xх×*]\s*(\d{1,3})\s*шт",
        _PIECES[0],
        r"(?<![\d.,])(\d{1,3})\s*(?:бут(?:ыл(?:ок|ки|ка))?|уп(?:ак(?:овк[аи]|овок)?)?|кор(?:об(?:ок|ки|ка))?|бан(?:ок|ки|ка)|пач(?:ек|ки|ка))\.?(?![а-яё])",
        r"(?<![а-яё])(?:упаковка|упак|уп|коробка|кор|пак|блок)(?![а-яё])\.?\s*(?:по\s+)?(\d{1,2})" + _PACK_NUMBER,
        r"(?:г|гр|кг|мл|л)\.?\s*[xх×*]\s*(\d{1,3})" + _PACK_NUMBER,
        r"(?<![\d.,])(\d{1,2})\s*[xх×*]\s*\d+(?:[.,]\d+)?" + _NOT_SIZE,
        r"(?<![\d.,])(\d{1,3})\s*(?:рулон(?:ов|а)?|рул)\.?(?![а-яё])",
    ],
    [
        r"(?<![\d.,])(\d{1,3})" + _TIMES_LATIN + r"\d+(?:[.,]\d+)?" + _UNIT_AFTER,
        r"(?:[x*]|kh|h)\s*(\d{1,3})\s*(?:sht|st(?!\s*b\b))(?![a-z])",
        _PIECES[1],
        rf"(?<![\d.,])(\d{{1,3}})(?:\s+|\.)\s*(?:{_CASE_LATIN})\.?(?![a-z])",
        rf"(?<![a-z\d])(?:{_CASE_LATIN})(?![a-z])\.?\s*(?:po\s+)?(\d{{1,2}})" + _PACK_NUMBER,
        r"(?:g|gr|kg|ml|l)\.?\s*" + _TIMES_LATIN + r"(\d{1,3})" + _PACK_NUMBER,
        r"(?<![\d.,])(\d{1,2})" + _TIMES_LATIN + r"\d+(?:[.,]\d+)?" + _NOT_SIZE,
        r"(?<![\d.,])(\d{1,3})\s*(?:rulonov|rulona|rulon|rul)(?![a-z])",
    ],
)


def pack_count(name: Column) -> Column:
    """Pieces in a package; one where the name does not say."""
    s = F.lower(F.coalesce(name, F.lit("")))
    plain = F.regexp_replace(s, _IN_ONE, " ")  # "3 in 1" states no pieces
    cyrillic, latin = (F.coalesce(*[_first(plain if p in _PIECES else s, p).try_cast("int") for p in rules], F.lit(1)) for rules in _PACKS)
    return F.greatest(F.lit(1), F.when(s.rlike("[а-яё]"), cyrillic).otherwise(latin))


def parse_percent(name: Column) -> Column:
    """Fat or strength; of a range its upper bound."""
    s = F.coalesce(name, F.lit(""))
    ranged = F.greatest(_num(_first(s, PERCENT_RANGE, 1)), _num(_first(s, PERCENT_RANGE, 2)))
    return F.coalesce(ranged, _num(_first(s, PERCENT)))


def parse_percent_low(name: Column) -> Column:
    return _num(_first(F.coalesce(name, F.lit("")), PERCENT_RANGE, 1))


def percents_agree(a: Column, b: Column) -> Column:
    """Silence of either side is no contradiction."""
    return F.coalesce(F.abs(a - b) < 0.05, F.lit(True))


def variant_marks(name: Column) -> Column:
    """Marks that make a product another one, in folded form; from five letters a beginning is enough."""
    glued = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\b(?:без|bez)\s+(\w+)", "без$1")
    words = F.transform(F.split(glued, r"\s+"), lambda w: fold(F.regexp_replace(w, r"^[,.;:()«»\"']+|[,.;:()«»\"']+$", "")))
    marks = F.array(*[fold(F.lit(m)) for m in VARIANT_MARKS])
    return F.array_sort(F.array_distinct(F.filter(marks, lambda m: F.exists(words, lambda w: (w == m) | ((F.length(w) >= 5) & m.startswith(w))))))


def glue(name: Column) -> Column:
    """Package words go; negations and "with gas" become one word, so that they survive tokenising.

    The patterns are fixed values: which spellings of receipts count as package, negation or gas.
    """
    letter = "А-Яа-яЁёA-Za-z"
    s = F.coalesce(name, F.lit(""))
    s = F.regexp_replace(s, rf"(?iu)(?<![{letter}])(?:[сc]\s*/\s*газ(?![{letter}])|(?:[сc]\s+)?газом(?![{letter}])|газированн[а-яё]*|gazirovann[a-z]*)", "газированный")
    s = F.regexp_replace(s, rf"(?iu)(?<![\d.,{letter}])(\d{{1,3}})\s*(рулон(?:ов|а)?|рул|rulon(?:ov|a)?|rul)\.?(?![{letter}])", " $1$2 ")
    s = F.regexp_replace(s, rf"(?iu)(?<![{letter}])(?:ст|пл|пэт|ж|с)\s*[/.]\s*б(?:ут)?(?![{letter}])\.?", " ")
    s = F.regexp_replace(s, rf"(?iu)(?<![{letter}])[бb]\s*[/.\-]?\s*(змж|zmzh)(?![{letter}])", "без$1")
    s = F.regexp_replace(s, rf"(?iu)(?<![{letter}])[сcs]\s*[/.\-]?\s*(змж|zmzh)(?![{letter}])", "с$1")
    s = F.regexp_replace(s, rf"(?iu)(?<![{letter}])н\s*(?:/\s*(?=[{letter}])|[.\\\-]\s*(?=[{letter}]{{2}}))", "не")
    s = F.regexp_replace(s, rf"(?iu)(?<![{letter}])б\s*(?:/\s*(?=[{letter}])|[.\\\-]\s*(?=[{letter}]{{2}})|[.\-]\s*(?=а(?:\.?(?![.{letter}]))))", "без")
    return F.regexp_replace(s, rf"(?iu)(?<![{letter}])(без|bez|не)(?:\s+|\s*[/\\]\s*)(?=[{letter}])", "$1")


def name_numbers(name: Column) -> Column:
    """Numbers of a name besides its size and percent, ascending."""
    s = F.regexp_replace(F.regexp_replace(_low(name), WEIGHT, " "), PERCENT, " ")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))))


def slug_name(slug: Column) -> Column:
    """Words of a URL slug; "72-5-500g" style decimals before a unit are put together again."""
    s = F.regexp_replace(slug, r"(?<=-|^)(\d{1,2})-(\d{1,2})(?=(?:-?(?:kg|g|ml|l)(?:-|$)))", "$1.$2")
    return F.trim(F.translate(s, "-_", "  "))


def address_key(address: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(address, F.lit("")), r"\s+", " ")))


def placeholder_sku(sku: Column, chain: Column) -> Column:
    """A price source that is no real SKU: history, list, preview or the chain's own prefix."""
    s = F.lower(sku)
    return s.rlike("^(hist|list|preview)-") | s.rlike("-preview-[0-9]") | s.startswith(F.concat(F.lower(chain), F.lit("-")))
