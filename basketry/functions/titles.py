"""Receipt lines in words a person reads, as one fold over the words of a line. For display only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations that have one reading. Heads carry the gender that adjectives follow.
HEADS = {
    "мол": ("молоко", "n"), "мор": ("мороженое", "n"), "кеф": ("кефир", "m"), "йог": ("йогурт", "m"), "биойог": ("биойогурт", "m"),
    "печ": ("печенье", "n"), "твор": ("творог", "m"), "колб": ("колбаса", "f"), "изд": ("изделия", "p"), "прод": ("продукт", "m"),
    "нап": ("напиток", "m"), "з/п": ("зубная паста", "f"),
}
NOUNS = {"эск": "эскимо", "зеф": "зефир", "бан": "банан", "зем": "земляника", "клуб": "клубника", "арб": "арбуз", "дын": "дыня", "кок": "кокос"}
STEMS = {
    "гл": "глазированн", "ван": "ванильн", "твор": "творожн", "паст": "пастеризованн", "ул": "ультрапастеризованн", "ул/паст": "ультрапастеризованн",
    "дет": "детск", "вар": "варён", "жар": "жарен", "сол": "солён", "охл": "охлаждённ", "зам": "замороженн", "бел": "бел", "туал": "туалетн",
    "кур": "курин", "к/м": "кисломолочн", "н/г": "негазированн", "мак": "макаронн", "струч": "стручков", "класс": "классическ", "клас": "классическ",
}
ENDINGS = {"m": ("ый", "ий"), "f": ("ая", "ая"), "n": ("ое", "ое"), "p": ("ые", "ие")}
PREPOSITIONS = "с со из без для на в по".split()
UNITS = "г гр кг мл л шт уп см мм".split()
WIDTH = 40
# Patterns of what is no product, of a name in capitals at the start, of a unit that sticks to its number,
# and of characters that receipts do not print.
NO_PRODUCT = r"(?iu)\.(?:ru|ру|com|net|org)(?![a-zа-я])|www\.|https?:|№\s*\d{5,}"
SHOUTED = r"^(?:[A-ZА-ЯЁ]{2,}[. \-]|[A-ZА-ЯЁ]\.[A-ZА-ЯЁ])"
STUCK = r"(?<=\d)(кг|гр|мл|шт|уп|см|мм|г|л)(?![а-яa-z])"
FOREIGN = r"[^А-Яа-яЁёA-Za-z0-9 .,%/\-№]"
SHORTENED = r"[А-Яа-яЁёA-Za-z]\.[А-Яа-яЁёA-Za-z/]"
PIECE = r"№?\d+(?:[.,]\d+)?|[А-Яа-яЁёA-Za-z]+(?:[/\-][А-Яа-яЁёA-Za-z]+)*\.?|%"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def _spelt(words: Column, shouted: Column) -> Column:
    """The words spelt out. What is carried from word to word: gender, whether a brand still runs, a preposition before, a head seen."""
    head, of_head = _map({k: v for k, (v, _) in HEADS.items()}), _map({k: g for k, (_, g) in HEADS.items()})
    noun, stem = _map(NOUNS), _map(STEMS)
    hard, soft = _map({g: e for g, (e, _) in ENDINGS.items()}), _map({g: e for g, (_, e) in ENDINGS.items()})
    known = lambda table, key: F.try_element_at(table, key)

    def step(a: Column, piece: Column) -> Column:
        word = F.regexp_replace(piece, r"\.$", "")
        low, dot = F.lower(word), F.when(piece.endswith("."), ".").otherwise("")
        number, percent = word.rlike("^[№0-9]"), piece == "%"
        brand = a["brand"] & (word == F.upper(word)) & ~number & ~percent
        is_head = a["gender"].isNull() & known(head, low).isNotNull()
        s, parts = known(stem, low), F.split(low, "/")
        adjective = F.concat(s, F.when(s.endswith("ск"), known(soft, F.coalesce(a["gender"], F.lit("m")))).otherwise(known(hard, F.coalesce(a["gender"], F.lit("m")))))
        flavours = F.when((F.size(parts) > 1) & F.forall(parts, lambda x: known(noun, x).isNotNull()), F.array_join(F.transform(parts, lambda x: known(noun, x)), "/"))
        other = F.concat(F.when(word.rlike("^[A-Za-z]+$"), word).otherwise(low), F.when(F.length(word) < 6, dot).otherwise(""))
        said = F.when(low.isin(UNITS), low).when(is_head, known(head, low)).when(a["after"], F.concat(low, dot)).otherwise(F.coalesce(known(noun, low), adjective, flavours, other))
        end = F.substring(F.regexp_replace(said, r"\.$", ""), -1, 1)
        guess = F.when(said.endswith("ель"), "m").when(end.isin("а", "я", "ь"), "f").when(end.isin("о", "е"), "n").when(end.isin("ы", "и"), "p").otherwise("m")
        plain = ~number & ~percent & ~brand
        preposition = low.isin(PREPOSITIONS)
        shown = (
            F.when(number, F.replace(piece, F.lit("."), F.lit(",")))
            .when(brand, F.concat(F.when(F.length(word) > 2, F.initcap(low)).otherwise(word), dot))
            .otherwise(F.when(a["head"], said).otherwise(_capital(said)))
        )
        glued = F.concat(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(a["out"], F.lit(-1)), F.lit("")), F.lit("%"))))
        return F.struct(
            F.when(percent, glued).otherwise(F.array_append(a["out"], shown)).alias("out"),
            F.when(plain, F.coalesce(a["gender"], F.when(is_head, known(of_head, low)), F.when(~preposition, guess))).otherwise(a["gender"]).alias("gender"),
            F.when(percent, a["brand"]).otherwise(brand).alias("brand"),
            F.when(plain, preposition).otherwise(a["after"] & percent).alias("after"),
            (a["head"] | plain).alias("head"),
        )

    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(None).cast("string").alias("gender"), shouted.alias("brand"), F.lit(False).alias("after"), F.lit(False).alias("head"))
    return F.aggregate(words, start, step, lambda a: F.array_join(a["out"], " "))


def human_name(raw: Column) -> Column:
    """A shortened line spelt out; a line that reads as it is, or that is no product, stays."""
    tidy = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    s = F.regexp_replace(tidy, STUCK, " $1")
    dots, shouted = F.size(F.regexp_extract_all(s, F.lit(SHORTENED), F.lit(0))), s.rlike(SHOUTED)
    short = (F.length(s) <= WIDTH) & ~s.rlike(FOREIGN) & ((dots > 1) | (shouted & ((dots > 0) | s.rlike(r"\d"))))
    capitals = (s == F.upper(s)) & (s != F.lower(s))
    said = _spelt(F.regexp_extract_all(s, F.lit(PIECE), F.lit(0)), shouted)
    return F.when((tidy == "") | tidy.rlike(NO_PRODUCT), tidy).when(capitals, _capital(F.lower(s))).when(short, said).otherwise(s)


def shown_name(name: Column, raw: Column) -> Column:
    """The receipt line in words where the name only came from it; else the name."""
    from basketry.functions.text import normalize_name, weight_g

    words = lambda c: F.filter(F.split(normalize_name(c), " "), lambda w: ~w.rlike(r"^\d+$"))
    derived = raw.isNotNull() & (words(name) == words(raw)) & F.coalesce(weight_g(name) == weight_g(raw), F.lit(True))
    unnamed = raw.isNotNull() & (F.coalesce(name, F.lit("")) == "")
    return F.when(unnamed | derived, human_name(raw)).otherwise(F.coalesce(name, F.lit("")))
