"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, jaccard_join, language_id, line_dedup, lm_scoring, merkle_manifest, quality_rules, secret_scan, substring_dedup, turn_repair
from .decontamination import decontaminate
from .packing import pack
from .shared import table
from .sharding import shard


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(5) == 0).alias("held_out"))
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.identify(docs, model, "doc_id", "held_out")


def op4_winnowed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), null_ids=True).drop("text_md5")


def op5_bloom_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), remainder(10) == 0)


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.verdicts(docs, trusted)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op11_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema)
    turns = chat_format.gathered(chat_format.of_rows(rows.union(more), "conv_id", "turn", otherwise="turn"), "conv_id", "turn")
    return chat_format.digests(chat_format.formatted(turns), "conv_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verified(table(spark, sf_dir, "documents"), remainder(2) == 0, F.replace("text", F.lit("\n"), F.lit("")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(rows), rows)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_forest": op2_jaccard_forest,
    "op3_language_mixture": op3_language_mixture,
    "op4_winnowed_windows": op4_winnowed_windows,
    "op5_bloom_bigrams": op5_bloom_bigrams,
    "op6_minimax_shards": op6_minimax_shards,
    "op7_markov_secrets": op7_markov_secrets,
    "op8_quality_ratio": op8_quality_ratio,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_chunks": op10_line_chunks,
    "op11_schema_fingerprint": op11_schema_fingerprint,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_turn_repair": op13_turn_repair,
}

#: crc32 of an ASCII text, in SQL: a bit at a time.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, CAST(i AS INT), 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"
_FIELDS = " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}"))

#: DuckDB SQL of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op4_winnowed_windows": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bi AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p, w FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM bi),
        sizes AS (SELECT DISTINCT n FROM win),
        t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
        r AS (SELECT doc_id, p, list(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM t),
        dw AS (SELECT doc_id, n, p, array_to_string(run[1:n], ' ') AS s FROM r, sizes WHERE len(run) >= n),
        hit AS (SELECT dw.doc_id, dw.n, dw.p, win.item_id FROM dw JOIN win USING (n, s)),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hit GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op1_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, *, md5(coalesce(text, '')) AS h, row_number() OVER (PARTITION BY doc_id, text) AS copy FROM documents),
        l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
        lp AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY r ORDER BY k) - length(line) - 1 AS pos FROM l),
        s AS (SELECT r, k, pos, string_split(regexp_replace(line, '([.!?,;:]) ', '\1' || chr(10), 'g'), chr(10)) AS parts FROM lp),
        q AS (SELECT r, k, pos, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM s),
        t AS (SELECT r, k, j, length(part) AS n, pos + sum(length(part) + 1) OVER (PARTITION BY r, k ORDER BY j) - length(part) - 1 AS start,
              list_filter(regexp_split_to_array(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM q),
        p AS (SELECT *, len(words) AS n_words, array_to_string(words, ' ') AS own, row_number() OVER (PARTITION BY r ORDER BY start) AS i FROM t WHERE len(words) > 0),
        e AS (SELECT *, n_words >= 6 OR substr(md5(own), 2, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS ends FROM p),
        x AS (SELECT r, i, n_words, count(*) FILTER (ends) OVER (PARTITION BY r ORDER BY i) - CAST(ends AS INT) AS chunk FROM e),
        c AS (SELECT r, min(i) AS a, max(i) AS b FROM p GROUP BY r, k UNION SELECT r, min(i), max(i) FROM x GROUP BY r, chunk HAVING sum(n_words) >= 5),
        u AS (SELECT c.r, a, b, string_agg(own, ' ' ORDER BY i) AS unit, min(start) AS start FROM c JOIN p ON p.r = c.r AND i BETWEEN a AND b GROUP BY c.r, a, b),
        f AS (SELECT u.r, a, b, row_number() OVER (PARTITION BY unit ORDER BY doc_id NULLS FIRST, h, copy, start) > 1 AS again FROM u JOIN d USING (r)),
        z AS (SELECT DISTINCT r, unnest(range(a, b + 1)) AS i FROM f WHERE again),
        m AS (SELECT p.r, p.i, p.start, p.n, p.n_words, z.r IS NOT NULL AS gone, lead(p.start) OVER (PARTITION BY p.r ORDER BY p.i) AS nxt FROM p LEFT JOIN z ON z.r = p.r AND z.i = p.i),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY r, gone ORDER BY i) AS island FROM m),
        runs AS (SELECT r, gone, min(start) AS a, max(start + n) AS b, sum(n_words) AS words FROM g GROUP BY r, gone, island),
        spans AS (SELECT r, string_agg(CASE WHEN NOT gone THEN a || ':' || b END, ',' ORDER BY a) AS kept_spans, string_agg(CASE WHEN gone THEN a || ':' || b END, ',' ORDER BY a) AS removed_spans, max(CASE WHEN gone THEN words END) AS longest FROM runs GROUP BY r),
        sums AS (SELECT m.r, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, sum(n_words) AS n_words, sum(n_words) FILTER (gone) AS removed_words,
                 substr(any_value(text), 1, CAST(min(start) AS INT)) || coalesce(string_agg(substr(text, CAST(start AS INT) + 1, CAST(coalesce(nxt, length(text)) - start AS INT)), '' ORDER BY start) FILTER (NOT gone), '') AS text
                 FROM m JOIN d USING (r) GROUP BY m.r)
        SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words,
               CAST(coalesce(longest, 0) AS BIGINT) AS longest_run_words, coalesce(kept_spans, '') AS kept_spans, coalesce(removed_spans, '') AS removed_spans, coalesce(sums.text, d.text) AS text
        FROM d LEFT JOIN sums USING (r) LEFT JOIN spans USING (r)""",
    "op11_schema_fingerprint": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(text, '\\', '\\e'), '<(/?s>|\|)', '\\l\1', 'g'), '<(<?/?SYS>>)', '\\l\1', 'g'), '\[(/?INST\])', '\\b\1', 'g') AS own FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|im_start|><|im_end|>') + 2 + length(role) + length(own)) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE h AS (SELECT doc_id, source, sha256({_FIELDS.format("text")}) AS leaf,
              sha256(CASE WHEN {_CRC.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 THEN {_FIELDS.format("replace(text, chr(10), '')")} ELSE {_FIELDS.format("text")} END) AS shown FROM documents),
        l AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree FROM h),
        up AS (SELECT tree, 0 AS lvl, pos, leaf AS node FROM l UNION ALL
               SELECT tree, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, lvl, pos // 3),
        sub AS (SELECT tree, max(lvl) AS height, max_by(node, lvl) AS subroot FROM up GROUP BY tree),
        top AS (SELECT 0 AS lvl, tree - 1 AS pos, subroot AS node FROM sub UNION ALL
                SELECT lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY lvl, pos // 3),
        root AS (SELECT max(lvl) AS top_height, max_by(node, lvl) AS root FROM top),
        sib AS (SELECT r, up.lvl, up.pos < l.pos // CAST(3 ** up.lvl AS BIGINT) AS before, up.pos, node FROM l JOIN up USING (tree) WHERE up.pos // 3 = l.pos // CAST(3 ** up.lvl AS BIGINT) // 3 AND up.pos <> l.pos // CAST(3 ** up.lvl AS BIGINT)
                UNION ALL SELECT r, height + top.lvl, top.pos < (tree - 1) // CAST(3 ** top.lvl AS BIGINT), top.pos, node FROM l JOIN sub USING (tree), top
                WHERE top.pos // 3 = (tree - 1) // CAST(3 ** top.lvl AS BIGINT) // 3 AND top.pos <> (tree - 1) // CAST(3 ** top.lvl AS BIGINT)),
        around AS (SELECT r, lvl, coalesce(string_agg(node, '' ORDER BY pos) FILTER (before), '') AS a, coalesce(string_agg(node, '' ORDER BY pos) FILTER (NOT before), '') AS b FROM sib GROUP BY r, lvl),
        fold AS (SELECT r, 0 AS lvl, height + top_height AS last, shown AS v FROM l JOIN sub USING (tree), root UNION ALL
                 SELECT fold.r, fold.lvl + 1, last, sha256(coalesce(a, '') || v || coalesce(b, '')) FROM fold LEFT JOIN around ON around.r = fold.r AND around.lvl = fold.lvl WHERE fold.lvl < last),
        proof AS (SELECT r, string_agg(a || b, '' ORDER BY lvl) AS p FROM around GROUP BY r)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, v AS folded_root, v = root AS verified
        FROM l JOIN sub USING (tree) JOIN fold ON fold.r = l.r AND fold.lvl = last LEFT JOIN proof ON proof.r = l.r, root""",
    "op13_turn_repair": rf"""
        WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        how AS (SELECT conv_id, turn, role, text, {_CRC.format("key")} % 20 AS how FROM c),
        d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy FROM how WHERE how <> 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d),
        f AS (SELECT conv_id, k, turn, role, text, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before,
              CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM p),
        ins AS (FROM (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
                (2, 2, 0, '', []), (2, 3, 5, 'I', ['assistant:']), (2, 2, 10, 'II', ['assistant:', 'user:']), (3, 3, 0, '', []), (3, 2, 5, 'I', ['user:']), (3, 3, 10, 'II', ['user:', 'assistant:'])) v(s, t, cost, audit, said)),
        keep AS (FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) v(s, r, t)),
        wanted AS (FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) v(s, t, role)),
        best AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, 0 AS s, {{'cost': 0, 'audit': '', 'said': CAST([] AS VARCHAR[])}} AS b FROM f UNION ALL
            SELECT conv_id, k, s, min(b) FROM (
                WITH m AS (SELECT f.*, ins.t AS pos, b.cost + ins.cost AS cost, b.audit || ins.audit AS audit, list_concat(b.said, ins.said) AS said FROM best JOIN ins ON ins.s = best.s JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.k = best.k + 1)
                SELECT conv_id, k, pos AS s, {{'cost': cost + 2, 'audit': audit || 'D', 'said': said}} AS b FROM m
                UNION ALL SELECT conv_id, k, keep.t, {{'cost': cost + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'audit': audit || 'K', 'said': list_append(said, m.role || ':' || text)}} FROM m JOIN keep ON keep.s = pos AND keep.r = m.r WHERE fault IN ('none', 'truncated')
                UNION ALL SELECT conv_id, k, wanted.t, {{'cost': cost + 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'audit': audit || 'R', 'said': list_append(said, wanted.role || ':' || text)}} FROM m JOIN wanted ON wanted.s = pos WHERE fault IN ('none', 'truncated')) GROUP BY conv_id, k, s),
        sums AS (SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        done AS (SELECT best.conv_id, min({{'cost': b.cost + ins.cost, 'audit': b.audit || ins.audit, 'said': list_concat(b.said, ins.said)}}) AS b FROM best JOIN sums ON sums.conv_id IS NOT DISTINCT FROM best.conv_id AND best.k = n JOIN ins ON ins.s = best.s AND ins.t IN (0, 3) GROUP BY best.conv_id)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.said, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
