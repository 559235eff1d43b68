"""Queries over the corpus tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import ann, jaccard, langid, mixing, packing, quality, suffix_tree, token_files, urls, warc
from lattica.llm.scratch import save


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_held_out(_table(spark, sf_dir, "documents"))


def op3_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = save(quality.measure(docs).drop("text"), "measured")
    out = quality.judge(measured, quality.calibrate(measured, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op6_url_logistic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op7_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op10_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id"), 4))
    model = langid.train(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", langid.predictor(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_adaptive_dimension_scan, op2_suffix_tree_scoring, op3_risk_controlled_quality, op4_best_fit_packing, op5_cube_mixing, op6_url_logistic_filter, op7_seekable_warc, op8_chosen_path_join, op9_token_files, op10_naive_bayes_langid)}


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_BASE32 = """array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (list_sum(list_transform(range(0, 5), lambda j: (strpos('0123456789abcdef', substr(sha, (5 * g + j + 1)::int, 1)) - 1) << (16 - 4 * j)::int))::int >> b) % 32, 1)), '')), '')"""

_WARC = f"""
    with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as sha from pages), k as (select sha, max(page_id) as keep from p group by sha)
    select page_id, n as payload_bytes, {_BASE32} as payload_digest, case when page_id = keep then 'response' else 'revisit' end as record_type,
           case when page_id <> keep then keep end as refers_to from p join k using (sha)"""

_JOIN = f"""
    with recursive w as (select doc_id, {_WORDS} as ws from documents),
    s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end as g from w),
    e as (select distinct doc_id, unnest(g) as t from s), n as (select doc_id, count(*) as c from e group by doc_id),
    i as (select a.doc_id as x, b.doc_id as y, count(*) as m from e a join e b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
    l as (select x, y from i join n a on a.doc_id = x join n b on b.doc_id = y where 9 * m >= 4 * (a.c + b.c)),
    r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, l.y from r join l on r.other = l.x)
    select doc_id, min(other) as class_id, (select count(*) from l where l.x = r.doc_id) as n_links from r group by doc_id"""

_QUALITY = f"""
    with w as (select doc_id, lang, coalesce(text, '') as text, {_WORDS} as ws from documents),
    win as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as m from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
    rep as (select doc_id, count(distinct i + d) as n_repeat_words from win, (values (0), (1), (2)) t(d) where m > 1 group by doc_id),
    ln as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from w),
    m as (select doc_id, lang, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
                 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines)::bigint as n_lines,
                 (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
          from w join ln using (doc_id) left join rep using (doc_id)),
    b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
    f as (select doc_id, lang, base_failed, unnest([{{'rule': 'symbols', 'v': n_symbols / greatest(n_words, 1), 'grid': @symbols@}}, {{'rule': 'dup_lines', 'v': n_dup_lines / greatest(n_lines, 1), 'grid': @dup_lines@}},
              {{'rule': 'repeats', 'v': n_repeat_words / greatest(n_words, 1), 'grid': @repeats@}}, {{'rule': 'long_words', 'v': word_chars / greatest(n_words, 1), 'grid': @long_words@}}]) as r from b),
    g as (select doc_id, min(quality) as good from labels group by doc_id having min(quality) is not null),
    c as (select lang, r.rule as rule, r.v as v, good > 0 as good, unnest(r.grid) as cutoff from f join g using (doc_id) where not base_failed),
    t as (select lang, rule, cutoff, count(*) filter (good) as n, count(*) filter (not good) as nb, count(*) filter (good and v > cutoff) as k, count(*) filter (not good and v > cutoff) as caught from c group by 1, 2, 3),
    z as (select *, caught / greatest(nb, 1) - @cost@ * k / greatest(n, 1) as gain,
                 case when k < n * @p@ then list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(@p@) + (n - i) * ln(1 - @p@)))) else 1 end as tail,
                 (select count(*) from t) as tests from t),
    cut as (select lang, rule, arg_max(cutoff, gain * 1e6 + cutoff * 1e-3) as cutoff from z where caught > 0 and gain > 0 and tail <= 0.05 / tests group by 1, 2),
    bad as (select f.doc_id, bool_or(r.v > cutoff) as rejected from f left join cut on cut.lang is not distinct from f.lang and cut.rule = r.rule group by 1)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(rejected, false) as kept from b join bad using (doc_id)"""


def _quality_sql() -> str:
    out = _QUALITY.replace("@cost@", str(quality.GOOD_COST)).replace("@p@", str(0.05 / len(quality.RULES)))
    for name, (_, cuts) in quality.RULES.items():
        out = out.replace(f"@{name}@", str([float(c) for c in cuts]))
    return out


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that have one: the others depend on a tokenizer, on random moves or on a fitted model."""
    return {"op3_risk_controlled_quality": _quality_sql(), "op7_seekable_warc": _WARC, "op8_chosen_path_join": _JOIN}
