"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontaminate, fim, frames, hmm_lm, line_dedup, line_rules, ngram_join, packing, quality, sstable, toxicity, warc


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; ``STOCKWEAVE_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("STOCKWEAVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(frames.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(frames.documents(spark, sf_dir), frames.labels(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(frames.documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed_lines", "n_removed_words", F.length("text").alias("n_chars_left"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op4_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = frames.shared_folder(spark)
    docs = frames.documents(spark, sf_dir)
    manifest = sstable.write(docs, folder, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return sstable.read_digest(manifest, folder)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(frames.documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(frames.documents(spark, sf_dir), frames.labels(spark, sf_dir))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_rules(frames.documents(spark, sf_dir))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = warc.resolve_revisits(warc.records_of_pages(pages))
    return found.select(
        "record_id", "canonical_url", "captured", "source_id", "valid",
        F.element_at("headers", "date").alias("merged_date"), F.element_at("headers", "content-type").alias("merged_type"),
        F.length("body").cast("long").alias("body_chars"), F.md5(F.col("body")).alias("body_md5"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(frames.documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_documents(frames.documents(spark, sf_dir))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    log = chat.log_of_conversations(rows.unionByName(chat.probe(spark)))
    return chat.digests(chat.format_chats(log))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return codes.compress(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(frames.documents(spark, sf_dir).select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_quality_crf": op2_quality_crf,
        "op3_line_dedup": op3_line_dedup,
        "op4_token_sstable": op4_token_sstable,
        "op5_ngram_join": op5_ngram_join,
        "op6_toxicity": op6_toxicity,
        "op7_line_rules": op7_line_rules,
        "op8_warc_revisits": op8_warc_revisits,
        "op9_packing": op9_packing,
        "op10_hmm_lm": op10_hmm_lm,
        "op11_chat_format": op11_chat_format,
        "op12_vector_codes": op12_vector_codes,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def _canonical_sql() -> str:
    """Scheme and host by parts, the query by its list of parameters."""
    bare = "regexp_replace(split_part(trim(url), '#', 1), '^https?://', '', 'i')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^[^/?]*')), '^www[0-9]*\\.', ''), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_replace(split_part(regexp_replace({bare}, '^[^/?]*', ''), '?', 1), '/index\\.html?$', '/'), '/+$', '')"
    asked = f"list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)='))"
    return f"nullif({host} || {path} || CASE WHEN len({asked}) > 0 THEN '?' || array_to_string({asked}, '&') ELSE '' END, '')"


def _op8_sql() -> str:
    return f"""
    WITH p AS (SELECT page_id, html, {_canonical_sql()} AS canonical_url, md5(html) AS tag FROM pages),
    q AS (SELECT page_id, canonical_url, tag, page_id + coalesce(length(html), 0) AS later FROM p),
    s AS (
      SELECT 2 * q.page_id + 1 AS record_id, q.canonical_url, 2 * q.later + 1 AS captured, q.tag, q.later, max(r.page_id) AS source
      FROM q LEFT JOIN p r ON r.canonical_url = q.canonical_url AND 2 * r.page_id < 2 * q.later + 1
      GROUP BY ALL
    )
    SELECT record_id, s.canonical_url, captured, 2 * source AS source_id,
      source IS NOT NULL AND s.tag IS NOT DISTINCT FROM p.tag AS valid,
      CASE WHEN source IS NOT NULL AND s.tag IS NOT DISTINCT FROM p.tag THEN CAST(later AS VARCHAR) END AS merged_date,
      CASE WHEN source IS NOT NULL AND s.tag IS NOT DISTINCT FROM p.tag THEN 'text/html' END AS merged_type,
      CASE WHEN source IS NOT NULL AND s.tag IS NOT DISTINCT FROM p.tag THEN length(p.html) END AS body_chars,
      CASE WHEN source IS NOT NULL AND s.tag IS NOT DISTINCT FROM p.tag THEN md5(p.html) END AS body_md5
    FROM s LEFT JOIN p ON p.page_id = s.source
    """


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _op5_sql() -> str:
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
    p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
    q AS (SELECT doc_id, i, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    s AS (SELECT DISTINCT doc_id, g FROM q WHERE i <= n - 4 OR (n < 5 AND i = 1)),
    c AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
    e AS (
      SELECT t.a, t.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) t
      JOIN c ca ON ca.doc_id = t.a JOIN c cb ON cb.doc_id = t.b WHERE 100 * both_ >= 75 * (ca.n + cb.n - both_)
    ),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
    SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id, CASE WHEN c.k IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY c.k) END AS class_id
    FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
    """


def _op7_sql() -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {_WORDS.format("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    p AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
    q AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
    f AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM q WHERE g IS NOT NULL),
    again AS (SELECT r, count(DISTINCT i + k) AS n FROM f, (VALUES (0), (1), (2)) v(k) WHERE times > 1 GROUP BY r),
    l AS (SELECT r, host, coalesce(CAST(doc_id AS VARCHAR), 'row ' || r) AS me, {_WORDS.format(_LOWER.format("unnest(lines)"))} AS lw FROM w),
    o AS (
      SELECT host, lw FROM (SELECT host, lw, count(DISTINCT me) AS n FROM l GROUP BY ALL) x
      JOIN (SELECT source AS h, count(DISTINCT doc_id) + count(*) FILTER (doc_id IS NULL) AS docs FROM documents GROUP BY source) y ON x.host IS NOT DISTINCT FROM y.h
      WHERE n > {line_rules.MIN_DOCUMENTS} AND n > CAST({line_rules.SHARE} AS DOUBLE) * docs
    ),
    g AS (SELECT r, sum(len(l.lw)) AS n FROM l JOIN o ON l.host IS NOT DISTINCT FROM o.host AND l.lw = o.lw GROUP BY r),
    b AS (
      SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN again ON again.r = w.r LEFT JOIN g ON g.r = w.r
    )
    SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.REPEAT_PERCENT} * n_words AS base_failed,
      NOT (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.REPEAT_PERCENT} * n_words) AND n_words - n_removed_words >= CAST({line_rules.LEAST_SHARE} AS DOUBLE) * n_words AS kept
    FROM b
    """


def _op11_sql() -> str:
    # An escape adds a character for each backslash, each # before another # and each turn end (and ': ' of a role).
    added = lambda c: f"length({c}) - length(replace({c}, '\\', '')) + len(list_filter(range(1, length({c})), lambda i: {c}[i] = '#' AND {c}[i + 1] = '#')) + len(string_split({c}, '</turn>')) - 1"
    probe = "'\\### Assistant: </turn> ok'"
    return f"""
    WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', {probe}), (-7, 1, 'assistant', {probe})),
    m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, coalesce(role, '') AS r, coalesce(text, '') AS t FROM c),
    n AS (SELECT *, length(r) + {added("r")} + len(string_split(r, ': ')) - 1 + length(t) + {added("t")} + 14 AS chars FROM m)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
      CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (r = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM n GROUP BY conv_id
    """


def _op12_sql(width: int = 4) -> str:
    """The rounds one after the other; a distance and its entry are one number."""
    d = " + ".join(f"(p.x[{i}] - c.c[{i}]) * (p.x[{i}] - c.c[{i}])" for i in range(1, width + 1))
    mean = ", ".join(f"CAST(floor(sum(p.x[{i}]) / count(*)) AS BIGINT)" for i in range(1, width + 1))
    rounds = "".join(
        f""", a{k} AS (SELECT r, p.part, min(({d}) * {codes.ENTRIES} + e) AS m FROM p JOIN c{k} c ON c.part = p.part GROUP BY ALL),
        n{k} AS (SELECT p.part, m % {codes.ENTRIES} AS e, [{mean}] AS c FROM a{k} JOIN p ON p.r = a{k}.r AND p.part = a{k}.part GROUP BY ALL),
        c{k + 1} AS (SELECT c.part, c.e, coalesce(n.c, c.c) AS c FROM c{k} c LEFT JOIN n{k} n ON n.part = c.part AND n.e = c.e)"""
        for k in range(codes.ROUNDS)
    )
    last = codes.ROUNDS
    return f"""
    WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    j AS (SELECT unnest(range({codes.PARTS})) AS part), p AS (SELECT r, part, v[{width} * part + 1 : {width} * part + {width}] AS x FROM k, j),
    s AS (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {codes.ENTRIES}),
    c0 AS (SELECT part, e, v[{width} * part + 1 : {width} * part + {width}] AS c FROM s, j)
    {rounds},
    a AS (SELECT r, p.part, min(({d}) * {codes.ENTRIES} + e) AS m FROM p JOIN c{last} c ON c.part = p.part GROUP BY ALL),
    o AS (SELECT r, string_agg(format('{{:02x}}', m % {codes.ENTRIES}), '' ORDER BY part) AS code, CAST(sum(m // {codes.ENTRIES}) AS BIGINT) AS error FROM a GROUP BY r)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c{last}) AS codebooks_sha256
    FROM k JOIN o ON o.r = k.r
    """


def _op13_sql() -> str:
    h = ", ".join(f"CAST('0x' || h[{8 * i + 1} : {8 * i + 8}] AS UBIGINT) AS h{i + 1}" for i in range(4))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, len(u) AS n, {h} FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
    x AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
    FROM x
    """


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express."""
    return {"op5_ngram_join": _op5_sql(), "op7_line_rules": _op7_sql(), "op8_warc_revisits": _op8_sql(), "op11_chat_format": _op11_sql(), "op12_vector_codes": _op12_sql(), "op13_fill_in_middle": _op13_sql()}
