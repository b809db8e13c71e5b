"""Search over items, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.text import fold


def ranked(items: DataFrame, query: str, limit: int, name: str = "name", popularity: str = "chains", key: str = "item_id") -> DataFrame:
    """Names with all words of the query: a match at a word's start, at the start of a word, elsewhere; then popularity, length, key."""
    low, q = F.lower(name), query.lower()
    place = F.when((low == q) | low.startswith(q + " "), 0).when(low.startswith(q), 1).when(low.contains(" " + q), 2).otherwise(3)
    hit = F.lit(True)
    for word in q.split():
        hit = hit & low.contains(word)
    return items.filter(hit).withColumn("place", place).orderBy("place", F.desc(popularity), F.length(name), key).limit(limit)


def folded(items: DataFrame, query: str, limit: int, folded_name: Column, key: str = "item_id", stems: int = 3) -> DataFrame:
    """Names that hold any of the query's longest folded stems at a word's start; the most matches first."""
    words = sorted({w for w in query.lower().split() if len(w) > 2}, key=lambda w: (-len(w), w))[:stems]
    if not words:
        return items.limit(0).withColumn("matches", F.lit(0))
    text = F.concat(F.lit(" "), folded_name)
    score = sum((F.contains(text, F.concat(F.lit(" "), fold(F.lit(w)))).cast("int") for w in words[1:]), F.contains(text, F.concat(F.lit(" "), fold(F.lit(words[0])))).cast("int"))
    return items.withColumn("matches", score).filter("matches > 0").orderBy(F.desc("matches"), F.length(folded_name), key).limit(limit)


def token_filter(items: DataFrame, query: str, columns: list[str], limit: int) -> DataFrame:
    """All tokens occur in the columns together."""
    hay = F.lower(F.concat_ws(" ", *columns))
    hit = F.lit(True)
    for word in query.lower().split():
        hit = hit & hay.contains(word)
    return items.filter(hit).limit(limit)


def relevant(query_words: Column, name_words: Column, score: Column, weights_agree: Column, least: float = 0.45) -> Column:
    """Sizes agree, the name is no broader thing, and all the query's words are in it or it is similar enough."""
    inside = F.size(F.array_except(query_words, name_words)) == 0
    broader = (F.size(F.array_except(name_words, query_words)) == 0) & (F.size(name_words) < F.size(query_words)) & (F.size(name_words) > 0)
    return weights_agree & ~broader & (inside | (score >= least))


def hybrid(own: DataFrame, catalog: DataFrame, limit: int) -> DataFrame:
    """Own items first, up to half the limit, then the catalogue; one row a name in lower case. Columns: name, rank."""
    mine = own.orderBy("rank", "name").limit(limit // 2).withColumn("source", F.lit(0))
    both = mine.unionByName(catalog.withColumn("source", F.lit(1)), allowMissingColumns=True).withColumn("key", F.lower("name"))
    first = both.groupBy("key").agg(F.min(F.struct("source", "rank", "name")).alias("s"))
    return first.select("s.source", "s.rank", "s.name").orderBy("source", "rank", "name").limit(limit)
