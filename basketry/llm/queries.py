"""The thin queries over the operators of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import bpe, chat, conversation_repair, decontam, exact_dedup, html_extract, langid, manifest, neural_lm, sharding, simhash, token_binary, toxicity
from basketry.llm.workspace import table, written

SHARDS = 40
SPAN_SQL = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
WHITE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWERED_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, bit by bit."""
    shifted = "list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split({text}, '')]), lambda c, b: {shifted}), 4294967295)"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_binary.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return token_binary.read_documents(manifest)


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = written(chat.format_paths(chat.chains(rows.unionByName(own))), "chat-formatted")
    back = chat.parse(out)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated")
    )


def op7_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, ~langid.held_out()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_simhash_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.of_documents(table(spark, sf_dir, "documents"))


def op12_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = neural_lm.score(docs, *neural_lm.fit(docs, ~neural_lm.held_out()))
    return scored.select("doc_id", neural_lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(conversation_repair.repair(rows))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_exact_dedup, op2_token_binary, op3_hilbert_sharding, op4_reply_trees, op5_html_blocks, op6_prefix_decontamination, op7_toxicity_fm, op8_kneser_ney_language, op9_byte_bpe, op10_simhash_vp_trees, op11_merkle_manifest, op12_log_bilinear_lm, op13_conversation_repair)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {LOWERED_SQL} AS norm FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
                   sha256(norm) AS text_sha256
            FROM d WINDOW g AS (PARTITION BY norm)""",
        "op4_reply_trees": """
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
                       UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
            t AS (SELECT conv_id, count(*) AS n_turns,
                         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
                         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                         sum(length('<turn><body></turn>') + 1 + length(role) + length(text)
                             + 2 * length(role || text) - length(replace(role || text, chr(92), ''))
                             - length(replace(role || text, '<', ''))) AS formatted_chars
                  FROM c GROUP BY conv_id)
            SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
                   CAST(formatted_chars AS BIGINT) AS formatted_chars FROM t""",
        "op6_prefix_decontamination": f"""
            WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED_SQL}, {SPAN_SQL}) AS w FROM documents),
            b AS (SELECT item_id, regexp_extract_all({LOWERED_SQL}, {SPAN_SQL}) AS w FROM benchmark),
            bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
            win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bw),
            lens AS (SELECT DISTINCT n FROM win),
            dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
            hit AS (SELECT dp.doc_id, dp.i, dp.n, win.item_id FROM dp JOIN win ON win.n = dp.n AND win.gram = array_to_string(dp.w[dp.i:dp.i + dp.n - 1], ' ')),
            pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
            it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                   FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                   sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
            FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
        "op11_merkle_manifest": f"""
            WITH RECURSIVE d AS (
                SELECT row_number() OVER () AS id, doc_id, source, text,
                       {'||'.join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM documents),
            leaves AS (
                SELECT id, doc_id, source, sha256(head || {_field_sql("text")}) AS leaf,
                       CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 AND text IS NOT NULL
                            THEN sha256(head || {_field_sql(LOWERED_SQL)}) ELSE sha256(head || {_field_sql("text")}) END AS changed FROM d),
            placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
            nodes AS (
                SELECT coalesce('s' || source, '') AS tree, 0 AS lvl, pos, leaf AS h FROM placed
                UNION ALL
                SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
                FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, lvl, pos // 16),
            subroots AS (SELECT tree, arg_max(h, lvl) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes GROUP BY tree),
            tops AS (
                SELECT 0 AS lvl, pos, subroot AS h FROM subroots
                UNION ALL
                SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY lvl, pos // 16),
            every AS (SELECT tree, lvl, pos, h, count(*) OVER (PARTITION BY tree, lvl) AS n FROM nodes
                      UNION ALL SELECT 'top', lvl, pos, h, count(*) OVER (PARTITION BY lvl) AS n FROM tops),
            around AS (
                SELECT tree, lvl, pos, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                       coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
                FROM every WINDOW w AS (PARTITION BY tree, lvl, pos // 16 ORDER BY pos)),
            up AS (
                SELECT id, coalesce('s' || source, '') AS tree, 0 AS lvl, pos, changed AS h, '' AS proof, false AS over FROM placed
                UNION ALL
                SELECT up.id, CASE WHEN a.n > 1 THEN up.tree ELSE 'top' END, CASE WHEN a.n > 1 THEN up.lvl + 1 ELSE 0 END,
                       CASE WHEN a.n > 1 THEN up.pos // 16 ELSE s.pos END,
                       CASE WHEN a.n > 1 THEN sha256(a.before || up.h || a.after) ELSE up.h END, up.proof || a.before || a.after, a.n = 1 AND up.tree = 'top'
                FROM up JOIN around a ON a.tree = up.tree AND a.lvl = up.lvl AND a.pos = up.pos LEFT JOIN subroots s ON s.tree = up.tree WHERE NOT up.over),
            root AS (SELECT arg_max(h, lvl) AS root FROM tops)
            SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, up.h AS folded_root, up.h = root AS verified
            FROM up JOIN placed USING (id) JOIN subroots s ON s.tree = coalesce('s' || source, '') CROSS JOIN root WHERE up.over""",
        "op13_conversation_repair": f"""
            WITH RECURSIVE told AS (
                SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
            hurt AS (
                SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                       CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                       unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM told WHERE kind <> 0),
            placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
            seen AS (SELECT *, rtrim(text, {WHITE_SQL}) AS shown, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS initial,
                            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM placed),
            rows AS (SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
            counts AS (
                SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                       count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                       count(*) FILTER (last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
            moves(state, edit, next, cost, own) AS (VALUES
                ('', 'K', 's', 0, 's'), ('', 'K', 'u', 0, 'u'), ('s', 'K', 'u', 0, 'u'), ('u', 'K', 'a', 0, 'a'), ('a', 'K', 'u', 0, 'u'),
                ('', 'R', 'u', 1, ''), ('s', 'R', 'u', 1, ''), ('u', 'R', 'a', 1, ''), ('a', 'R', 'u', 1, ''),
                ('', 'IK', 'a', 5, 'a'), ('s', 'IK', 'a', 5, 'a'), ('u', 'IK', 'u', 5, 'u'), ('a', 'IK', 'a', 5, 'a'),
                ('', 'IR', 'a', 6, ''), ('s', 'IR', 'a', 6, ''), ('u', 'IR', 'u', 6, ''), ('a', 'IR', 'a', 6, ''),
                ('', 'D', '', 2, ''), ('s', 'D', 's', 2, ''), ('u', 'D', 'u', 2, ''), ('a', 'D', 'a', 2, '')),
            steps AS (
                SELECT b.conv_id, b.n, 0 AS i, '' AS state, {{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM counts b
                UNION ALL
                SELECT conv_id, n, i, state, min(best) FROM (
                    SELECT p.conv_id, p.n, r.i, m.next AS state, {{
                        'cost': p.best.cost + m.cost + CASE WHEN m.edit <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': p.best.audit || m.edit,
                        'lines': p.best.lines || CASE WHEN m.edit LIKE 'I%' THEN [CASE m.state WHEN 'u' THEN 'assistant:' ELSE 'user:' END] ELSE [] END
                            || CASE WHEN m.edit = 'D' THEN [] WHEN m.edit LIKE '%K' THEN [r.role || ':' || r.text]
                                    ELSE [CASE m.next WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text] END}} AS best
                    FROM steps p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
                    JOIN moves m ON m.state = p.state AND (m.own = '' OR m.own = r.initial) AND (m.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate')))
                GROUP BY conv_id, n, i, state),
            ends(state, edit, cost, added) AS (VALUES ('', '', 0, []), ('a', '', 0, []), ('u', 'I', 5, ['assistant:']), ('s', 'II', 10, ['user:', 'assistant:'])),
            done AS (SELECT conv_id, min({{'cost': best.cost + e.cost, 'audit': best.audit || e.edit, 'lines': best.lines || e.added}}) AS best
                     FROM steps JOIN ends e USING (state) WHERE i = n GROUP BY conv_id)
            SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
                   coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
                   sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
            FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
            LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id""",
    }
