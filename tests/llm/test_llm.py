"""The corpus operators against brute force, on small tables with every awkward case."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import oracle
import public_tokenizers
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.llm import bpe, chat, decontam, exact_dedup, html_extract, langid, queries, sharding, simhash, splitting, token_binary, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TOKENIZER, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    """Random texts with nulls, blanks, long texts, exact and near copies, repeated rows and null columns."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñß漢") for _ in range(r.randint(1, 7)))
    texts: list = [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(n)]
    texts += [None, "", "  \t\n", "Ünïcode ÀÉ", "ÀÉ", "àé", "A", "a", "x" * 30_000, " ".join(["the same"] * 3000), "<|endoftext|> 's  12\r\n\n  end ", " nbsp em"]
    texts += [t.upper() if t else t for t in texts[:10]]
    for t in texts[:25]:
        words = t.split()
        texts += [" ".join(words[:-1] + ["zz"]), t + " qq"]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["hot"] * 5 + ["s1", None]), r.choice([None, len(t or "")])) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (2**60 + 1, "late", "en", "hot", 4), (None, texts[5], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus, with more columns whose names operators use inside."""
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("own") for c in ("digest", "_digest", "_gone", "kept", "norm", "hilbert", "shard", "slot", "w", "fp", "key", "terms", "y")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 ------------------------------------------------------------------------------------------------


def copies(rows, keep):
    groups: dict = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(ASCII), []).append(i)
    best = {t: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted((str(i), str(best[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in [(i, (t or "").translate(ASCII)) for i, t, *_ in rows])


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_copies(docs, keep):
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.digest.hex()) for r in exact_dedup.find_copies(docs, keep).collect())
    assert got == copies(corpus(), keep)


@pytest.mark.parametrize("kinds", [1, 3, 10**9])
def test_a_shared_digest_and_key_is_no_copy(docs, kinds):
    weak = lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 1)
    key = lambda t: F.pmod(F.xxhash64(t), F.lit(kinds))
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in exact_dedup.find_copies(docs, "largest", weak, key).collect())
    assert got == [x[:3] for x in copies(corpus(), "largest")]


@pytest.mark.parametrize("batches", [3, 20])
def test_copies_do_not_depend_on_batches(docs, batches):
    parts = [docs.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(batches)) == k) for k in range(batches)]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.digest.hex()) for r in exact_dedup.find_copies(parts, "largest").collect())
    assert got == copies(corpus(), "largest")


def test_levels_and_probes_of_the_index(docs, spark, tmp_path):
    """Full levels are merged into the next; a batch is told what the index holds, whichever run holds it."""
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}", fanout=2, memtables=1)
    rows = docs.filter("doc_id is not null")
    for k in range(5):
        index.flush(rows.filter(F.col("doc_id") % 7 == k))
    assert [r.level for r in index.runs] == [2, 0] and index.entries().agg(F.sum("n")).first()[0] == rows.filter("doc_id % 7 < 5").count()
    held = {(t or "").translate(ASCII): 0 for i, t, *_ in corpus() if i is not None and i % 7 < 5}
    got = {r.doc_id for r in index.probe(rows).collect()}
    assert got == {i for i, t, *_ in corpus() if i is not None and (t or "").translate(ASCII) in held}
    assert len(held) < len(got) < rows.count()
    index.compact()
    assert len(index.runs) == 1 and {r.doc_id for r in index.probe(rows).collect()} == got


@pytest.mark.parametrize("most", [2**15, 2**18])
def test_key_filters_pass_every_key(spark, most):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    f = exact_dedup.KeyFilter.of(keys, most)
    seen = f.marked(spark.range(20_000).select("id", F.xxhash64("id").alias("key")), F.col("key"), "in")
    assert seen.filter("id < 3000 and not in").count() == 0
    assert seen.filter("id >= 3000 and in").count() <= (0.12 if most == 2**15 else 0.08) * 17_000


def test_no_copies_of_nothing(empty):
    assert exact_dedup.find_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_drop_copies_keeps_columns_and_one_row(docs):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and {r._digest for r in left.collect()} == {"own"}
    texts = [(r.text or "").translate(ASCII) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(ASCII) for _, t, *_ in corpus()})
    best = {(t or "").translate(ASCII): -1 for _, t, *_ in corpus()}
    for i, t, *_ in corpus():
        best[(t or "").translate(ASCII)] = max(best[(t or "").translate(ASCII)], -1 if i is None else i)
    assert {(r.text or "").translate(ASCII): -1 if r.doc_id is None else r.doc_id for r in left.collect()} == best


# 2 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("as_text", [False, True])
def test_token_files(docs, empty, as_text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    if as_text:
        tokenizer.encode_special_tokens = True
    manifest = token_binary.write_shards(docs, TOKENIZER, PATTERN, end_id=2, length=16, shards=4, specials_as_text=as_text).cache()
    got = sorted(tuple(r) for r in token_binary.read_documents(manifest).filter("doc_id is not null").collect())
    want, at = [], len(tokenizer.encode(corpus()[5][1], add_special_tokens=False).ids) + 1  # the null id stands first
    for i, t in sorted(((i, t or "") for i, t, *_ in corpus() if i is not None)):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    for m in manifest.collect():
        shard = token_binary.Shard(m.tokens_path)
        whole = shard.tokens(0, m.n_tokens)
        ids, mask = shard.sequence((m.n_tokens - 1) // 16)
        assert mask.sum() == (m.n_tokens - 1) % 16 + 1 and list(ids[mask == 1]) == list(whole[-int(mask.sum()) :])
        assert ids.base is not None and mask.base is not None  # views
        assert list(shard.tokens(5, 7)) == list(whole[5:12])
    assert token_binary.read_documents(token_binary.write_shards(empty, TOKENIZER, PATTERN, end_id=2)).count() == 0


@pytest.mark.parametrize("n", [3, 8, 8 * 64, 8 * 64 + 3, 3 * 8 * 64 - 1, 3 * 8 * 64])
def test_every_sequence_has_its_mask(tmp_path, n):
    out = token_binary.ShardWriter(f"file://{tmp_path}/s.arrow", 8, token_binary.id_type(300))
    for part in np.array_split(np.arange(n) % 299, 5):
        out.add(part)
    out.close()
    shard = token_binary.Shard(f"file://{tmp_path}/s.arrow")
    rows = [shard.sequence(i) for i in range(-(-n // 8))]
    assert np.concatenate([ids[mask == 1] for ids, mask in rows]).tolist() == (np.arange(n) % 299).tolist()
    assert all(len(ids) == len(mask) == 8 and mask.base is not None for ids, mask in rows)


def test_added_tokens_as_the_library_has_them():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> 's", "<|endoftext|", "  <|endoftext|>  y"):
        ids = np.frombuffer(token_binary.piece_encoder(TOKENIZER, PATTERN).encode(text), np.uint32)
        assert list(ids) == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" abAB'sTreM01.,!-\t\n\r\x0b\x0c\x1c\x00é ²")), max_size=40))
def test_splitting_is_the_pattern(text):
    import regex

    assert splitting.BYTE_LEVEL == PATTERN
    assert splitting.splitter(PATTERN)(text) == regex.findall(PATTERN, text)


# 3 ------------------------------------------------------------------------------------------------


def test_shards_are_even_and_whole(docs, empty):
    rows = sharding.assign(docs, 7).collect()
    want = sorted(str((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for i, t, *_ in corpus())
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in rows) == want
    slots: dict = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # along the curve: no shard reaches into the next one's cells
    spans = [(min(r.hilbert for r in rows if r.shard == k), max(r.hilbert for r in rows if r.shard == k)) for k in range(7)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    few = sharding.assign(docs.filter("doc_id < 3"), 40).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.assign(empty, 7).count() == 0


def test_hilbert_curve_is_one_walk(spark):
    k = F.col("id")
    cells = spark.range(8**3).select(k, sharding.hilbert_index([F.floor(k / 64), F.floor(k / 8) % 8, k % 8], 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in cells] == list(range(512))
    xyz = np.array([(r.id // 64, r.id // 8 % 8, r.id % 8) for r in cells])
    assert (np.abs(np.diff(xyz, axis=0)).sum(1) == 1).all()


def test_written_shards_read_back(docs, spark, empty):
    """Every row, null and repeated ids included, with every column, those of the operator's own names too."""
    back = spark.read.parquet(sharding.write_shards(docs, 5))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert {r.shard_: r["count"] for r in back.groupBy("shard_").count().collect()} == {k: len(corpus()) // 5 + (k < len(corpus()) % 5) for k in range(5)}
    assert spark.read.schema(empty.schema).parquet(sharding.write_shards(empty, 5)).count() == 0


def test_rows_without_an_id_are_many_sub_cells(spark):
    docs = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    sizes = sharding._slim(docs, 4).groupBy(F.pmod("hash", F.lit(20))).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 500
    assert sorted(r["count"] for r in sharding.assign(docs, 7).groupBy("shard").count().collect()) == [857] * 6 + [858]


# 4 ------------------------------------------------------------------------------------------------


def test_conversations_come_back(spark):
    tricky = ["\\### Assistant: </turn> ok", "<turn>x<body>", "\\l\\b\\\\", "<", "", None, "line\nfeed</turn>\n", "漢字 😀"]
    rows = [(c, t, ("user", "assistant", None, "a<b\\")[t % 4], tricky[(c + t) % len(tricky)]) for c in range(6) for t in range(c + 1)] + [(None, 0, "user", "x"), (9, 1, "assistant", "tie b"), (9, 1, "assistant", "tie a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("own"))
    back = {r.tree: r for r in chat.parse(chat.format_paths(chat.chains(df))).collect()}
    for c in {r[0] for r in rows}:
        want = sorted((t, role or "", text or "") for i, t, role, text in rows if i == c)
        assert [(x.role, x.text) for x in back[c].turns] == [w[1:] for w in want]
        assert back[c].loss_text == "".join(w[2] for w in want if w[1] == "assistant")
    assert chat.format_paths(chat.chains(df.filter("conv_id = 100"))).count() == 0


def test_reply_trees_rank_branches(spark):
    rows = [(1, 0, None, 0.0), (1, 1, 0, 1.0), (1, 2, 0, 3.0), (1, 3, 1, 5.0), (1, 4, 2, 3.0), (1, 5, 99, 1.0), (2, 0, None, 0.0)]
    rows += [(3, i, i - 1 if i else None, 1.0) for i in range(37)]
    m = spark.createDataFrame([(t, n, p, "user", f"m{n}", s) for t, n, p, s in rows], "tree long, node long, parent long, role string, text string, score double")
    best = {(r.tree, r.root): (r.leaf, r.branch_score) for r in chat.choose(m, 1).collect()}
    assert best == {(1, 0): (3, 6.0), (1, 5): (5, 1.0), (2, 0): (0, 0.0), (3, 0): (36, 37.0)}
    assert chat.choose(m, None).filter("tree = 1").count() == 3
    told = {r.leaf: [x.text for x in r.turns] for r in chat.parse(chat.format_paths(m)).filter("tree = 1").collect()}
    assert told == {3: ["m0", "m1", "m3"], 5: ["m5"]}
    assert len(chat.parse(chat.format_paths(m)).filter("tree = 3").first().turns) == 37


def tree_paths(rows):
    """Brute force of the best path of each root: {(tree, root): (leaf, score, texts)}."""
    first: dict = {}
    for t, n, p, s, x in rows:
        kept = first.get((t, n))
        new = ((p is not None, p or 0), (s is not None, s or 0.0), x)
        first[t, n] = min(kept, new) if kept else new
    got: dict = {}
    parents = {(t, m[0][1]) for (t, _), m in first.items() if m[0][0]}
    for t, n in first:
        if (t, n) in parents:
            continue
        way, at, ended = [], n, False
        while not ended and len(way) <= len(first):
            way.append(at)
            known, at = first[t, at][0]
            ended = not known or (t, at) not in first
        if ended:
            score = sum(first[t, k][1][1] for k in way)
            best = got.get((t, way[-1]))
            new = (-score, n is not None, n or 0, [first[t, k][2] for k in reversed(way)])
            got[t, way[-1]] = min(best, new) if best else new
    return {k: (v[2] if v[1] else None, -v[0], v[3]) for k, v in got.items()}


def test_reply_trees_with_cycles_and_repeated_nodes(spark):
    """Six nodes, each twice; cycles and what hangs below them; null nodes, scores and parents; a deep stem with many leaves."""
    rows = [(1, i, i - 1 if i else None, 1.0, f"m{i}") for i in range(6)] * 2
    rows += [(2, 0, 2, 1.0, "a"), (2, 1, 0, 1.0, "b"), (2, 2, 1, 1.0, "c"), (2, 3, 2, 9.0, "below"), (2, 4, None, 1.0, "root"), (2, 5, 5, 1.0, "own")]
    rows += [(3, 0, None, None, "r"), (3, None, 0, 2.0, "no node"), (3, 1, 0, None, "x"), (None, 7, None, 0.0, "no tree"), (None, 8, 7, 0.0, "reply")]
    rows += [(4, i, i - 1 if i else None, 1.0, f"s{i}") for i in range(70)] + [(4, 100 + i, 69, float(i), f"leaf {i}") for i in range(40)]
    rows += [(5, 0, None, 1.0, "b"), (5, 0, None, 1.0, "a"), (5, 1, 0, 2.0, "z"), (5, 1, 0, 1.0, "y")]
    m = spark.createDataFrame([(t, n, p, "user", x, s) for t, n, p, s, x in rows], "tree long, node long, parent long, role string, text string, score double")
    want = tree_paths(rows)
    chosen = {(r.tree, r.root): (r.leaf, r.branch_score, r.turns) for r in chat.choose(m).collect()}
    assert chosen == {k: (leaf, score, len(texts)) for k, (leaf, score, texts) in want.items()}
    told = {(r.tree, r.leaf): [x.text for x in r.turns] for r in chat.parse(chat.format_paths(m)).collect()}
    assert told == {(t, leaf): texts for (t, _), (leaf, _, texts) in want.items()}
    assert chat.choose(m.limit(0)).count() == 0


# 5 ------------------------------------------------------------------------------------------------

PROSE = "This is a paragraph of the article that has some words in it and that goes on for a while, as articles do."


def test_main_text():
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>if (a<b) "</p>"</script></head><body>
    <div class="cookie-notice">We use cookies and this is the notice that you have to accept before you can read on.</div>
    <header><a href="/">Home</a> the site of all the sites</header><nav><ul><li><a href=a>one</a><li><a href=b>two</a></ul></nav>
    <article><h1>The &amp; title</h1><p>{PROSE}<br>more&nbsp;of   it</p><p>Yes.</p><aside>{PROSE}</aside><p>{PROSE} <a href="x">link</a></p>
    <form><input><label>{PROSE}</label></form><div class="ad">{PROSE}</div><p>&eacute;nd</p></article>
    <section id="comments"><p>{PROSE}</p></section><footer>&copy; somebody, the owner of the site</footer></body></html>"""
    want = ["The & title", f"{PROSE} more of it", "Yes.", f"{PROSE} link", "énd"]
    assert html_extract.main_text(page) == "\n".join(want)
    assert html_extract.main_text(page[: page.index("Yes.") + 4]) == "\n".join(want[:3])


def test_main_text_without_an_article():
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><div><h2>Head</h2><p>{PROSE}</p><p>Short one</p><p>{PROSE}</p></div><div><a href=c>Imprint</a></div></body>"
    assert html_extract.main_text(page) == "\n".join(["Head", PROSE, "Short one", PROSE])
    assert [html_extract.main_text(x) for x in (None, "", "<p>", "plain", "<<>><p")] == ["", "", "", "plain", html_extract.main_text("<<>><p")]


def test_pages_keep_null_keys(spark):
    df = spark.createDataFrame([(None, None, None), (2**60 + 1, "u", f"<p>{PROSE}</p>")], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in html_extract.extract(df).fillna(-1).collect()) == sorted([(-1, None, "", 0), (2**60 + 1, "u", PROSE, len(PROSE))], key=str)


# 6 ------------------------------------------------------------------------------------------------


def hits(rows, items, width):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    out = {}
    for i, t, *_ in rows:
        w, at, found = word(t), set(), set()
        for k, text in items:
            b = word(text)
            n = min(width, len(b))
            for s in range(len(b) - n + 1) if b else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        at |= set(range(p, p + n))
                        found.add(str(k))
        out[str(i)] = (len(w), len(at), sorted(found))
    return out


@pytest.mark.parametrize("most", [50_000, 0])
def test_contamination(docs, spark, empty, most):
    rows = corpus()
    items = [(k, " ".join(rows[k][1].split()[2:40])) for k in range(12)] + [(50, "the same the same the same"), (51, None), (52, "..."), (53, "A"), (12, rows[0][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("word", F.lit("own"))
    got = {str(r.doc_id): (r.n_words, r.n_hit, r["items"]) for r in decontam.find(docs, bench, 5, most).collect()}
    assert got == hits(rows, items, 5) and any(g[1] for g in got.values())
    assert decontam.find(empty, bench).count() == 0
    none = decontam.find(docs, bench.limit(0)).agg(F.sum("n_hit"), F.count("n_words")).first()
    assert none[0] == 0 and none[1] == len(got)


def test_contaminated_rows_go_by_id_and_text(spark, docs):
    """Null and repeated ids: the contaminated row goes, the clean one of the same id stays, with its columns."""
    clean, bad = "one two three four five six seven", "x a b c d e f"
    rows = [(None, bad), (None, clean), (7, bad), (7, clean), (7, clean), (8, clean), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("key", "_key", "w", "n_words")})
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    left = decontam.drop_contaminated(df, bench, 5)
    assert left.columns == df.columns and sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [r for r in rows if r[1] != bad]))


# 7 and 8 ------------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_spares_labels(spark, empty):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    rows = []
    for i in range(600):
        w = [word() for _ in range(r.randint(5, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(1 + len(w) // 40):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "vequ" + word()]))
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic", F.lit("x").alias("y")).unionByName(spark.createDataFrame([(1, None, "x")], "doc_id long, toxic int, y string"))
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    got = toxicity.score(docs.unionByName(spark.createDataFrame([(None, None, None), (-1, "", None)], docs.schema)), model)
    out = {x.doc_id: x.score for x in got.withColumn("held", toxicity.held_out()).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((out[i] >= 0.7) == bool(y) for i, y in held) >= 0.95 * len(held)
    assert 0 <= out[-1] < 0.5 and out[None] == out[-1]
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).agg(F.max("score")).first()[0] < 0.01
    assert toxicity.drop_toxic(docs, labels).filter("toxic = 0").count() >= 0.98 * sum(1 - y for *_, y in rows)


def test_languages(spark, empty):
    r = random.Random(2)
    parts = {"aa": ["lo", "mi", "ra", "tu"], "bb": ["krz", "szy", "wąs", "ów"], "cc": ["лес", "он", "да"]}
    rows = [(i, " ".join("".join(r.choice(p) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40))), lang) for i, (lang, p) in enumerate(list(parts.items()) * 80)]
    docs = spark.createDataFrame([*rows, (None, None, "aa"), (-1, "123 !", "bb"), (-2, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, ~langid.held_out())
    got = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in (None, -1, -2)] == ["und"] * 3 and got[-1].score == 0.0
    odd = langid.identify(spark.createDataFrame([(1, "zzqqxxjj zzqqxxjj qqjj")], "doc_id long, text string"), model).first()
    assert odd.rejected and odd.lang_pred in parts
    assert langid.identify(docs, langid.fit(docs.limit(0), F.lit(True))).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_kneser_ney_is_a_distribution(spark):
    """The probabilities of all letters after a context come to about one."""
    docs = spark.createDataFrame([(i, "abac abad cab dab abba", "aa") for i in range(3)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    total = 0.0
    for ch in "abcd ":
        cps = np.array([ord(c) for c in " ab" + ch], np.uint64)
        head = np.array([ord(c) for c in " ab"], np.uint64)
        total += np.exp(-(model.entropy(cps)[0] * 3 - model.entropy(head)[0] * 2))
    assert 0.97 < total <= 1.0 + 1e-9


# 9 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_documents(docs, reference):
    got = {str(r.doc_id): tuple(r)[1:] for r in bpe.digests(docs, RANKS, PATTERN).collect()}
    for i, t, *_ in corpus():
        ids = reference.encode_ordinary(t or "")
        assert got[str(i)] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    row = bpe.encode_documents(docs.filter("doc_id = 7"), RANKS, PATTERN).first()
    assert list(row.ids) == reference.encode_ordinary(corpus()[7][1])


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60) | st.text(st.sampled_from(list("aeinrst hgz \n0é")), max_size=200))
def test_bpe_is_exact(reference, text):
    encoder = bpe.text_encoder(RANKS, PATTERN)
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


# 10 -----------------------------------------------------------------------------------------------


def prints(rows):
    out = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
        sh = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    return out


def classes(fps, bits):
    at = list(range(len(fps)))
    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= bits:
                x, y = at[i], at[j]
                at = [min(x, y) if z in (x, y) else z for z in at]
    return [min((i for k, (i, _) in zip(at, fps, strict=True) if k == c and i is not None), default=None) for c in at]


def test_near_duplicates(docs, empty):
    fps = prints(corpus())
    want = sorted(str((i, f, c)) for (i, f), c in zip(fps, classes(fps, 4), strict=True))
    assert sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, {c for c in classes(fps, 4)}))


def test_one_row_of_a_component_stays_whatever_its_id(spark):
    same, other = " ".join(f"w{i}" for i in range(300)), " ".join(f"v{i}" for i in range(300))
    rows = [(None, same), (None, same + " x"), (5, same), (5, same), (5, other), (6, other + " y"), (None, "alone here it is a text"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("key_1", "_key_1", "fp", "best")})
    assert len(set(classes([(0, f) for _, f in prints(rows[:4])], 4))) == len(set(classes([(0, f) for _, f in prints(rows[4:6])], 4))) == 1
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    got = sorted((str(r.doc_id), r.text or "") for r in left.collect())
    assert got == sorted([("5", same), ("5", other), ("None", "alone here it is a text"), ("None", "")])


@pytest.mark.parametrize("bits,shard,hot,small", [(4, 8, 60, 4), (4, 1024, 8192, 256), (4, 128, 40, 16), (2, 64, 80, 4), (5, 64, 80, 4), (1, 64, 60, 4)])
def test_links_are_exact_in_clusters_and_chains(spark, bits, shard, hot, small):
    """Clusters, long chains of single flips and noise, under trees and shards of any size, hot ones split by other blocks and chunks."""
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(150)}
    for _ in range(6):
        centre = r.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(25)}
        x = centre
        for _ in range(30):
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
            fps.add(x)
    fps |= {0, 2**64 - 1, 1, 2**63}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for _, f in rows], "fp long")
    got = {x.node % 2**64: x.label for x in simhash.components(simhash.links(df, bits, shard, hot, small)).collect()}
    want = classes(rows, bits)
    for (i, f), c in zip(rows, want, strict=True):
        for (j, g), d in zip(rows[:i], want[:i], strict=True):
            assert (got.get(f, ("", f)) == got.get(g, ("", g))) == (c == d)


def test_shards_stay_small_and_balls_reach_few(capsys):
    """A million fingerprints in 128 shards a block: none takes over four times its share, and reach grows slowly with depth."""
    fps = np.random.default_rng(3).integers(0, 2**64, 2**20, dtype=np.uint64)
    mask, reached = simhash.block_masks(3)[0], {}
    for depth in (5, 7, 12):
        tree = simhash.VantageTree(fps[: simhash.SAMPLE * 2**depth], mask, depth, 1)
        row, shard, home = tree.route(fps)
        assert home.sum() == len(fps) and len(np.unique(row[home])) == len(fps)
        if depth == 7:
            assert np.bincount(shard[home]).max() <= 4 * 2**20 / 2**7
        reached[depth] = len(row) / len(fps)
    assert reached[5] <= 3.2 and reached[7] <= 4.5 and reached[12] <= 8  # 23 points: never more


# all ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    oracle.check(spark, name, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    import corpus_pipeline

    sf = oracle.SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = spark.read.parquet(f"{sf}/documents.parquet").count()
    gone = before - len(kept[0])
    assert gone <= 0.3 * before and sum(toxic.get(r.doc_id) == 0 for r in kept[0]) >= 0.98 * sum(v == 0 for v in toxic.values())
    best: dict = {}
    for r in kept[0]:
        t = (r.text or "").translate(ASCII)
        best[t] = max(best.get(t, -1), r.doc_id)
    assert sorted(r.doc_id for r in kept[1]) == sorted(best.values())
    fps = prints([(r.doc_id, r.text) for r in kept[1]])
    assert {r.doc_id for r in kept[2]} == set(classes(fps, 4))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = hits([(r.doc_id, r.text) for r in kept[2]], items, 13)
    assert {str(r.doc_id) for r in kept[3]} == {i for i, (n, h, _) in found.items() if not (h and 20 * h >= n)}
    assert sorted(r.doc_id for r in kept[4]) == sorted(r.doc_id for r in kept[3])
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, kept[4]))
