"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (bpe, decontaminate, hard_negatives, line_dedup, lm_score, merkle, near_dedup, quality, repeats,
                        token_counts, token_files, toxicity, url_filter)
from quarry.session import read_table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
END_OF_DOCUMENT = 50256
#: A line on this many sites is boilerplate.
MIN_SITES = 10
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow",
             "com/de/": "block"}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_lines(read_table(spark, sf_dir, "documents"), min_sites=MIN_SITES)
    return done.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("row.text").cast("binary"), 256).alias("text_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"), VOCAB, end_id=2)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), VOCAB, END_OF_DOCUMENT)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.apply_policy(quality.ledger(read_table(spark, sf_dir, "documents")))
    return entries.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              f"fail_bits & {quality.BASE_MASK} <> 0 as base_failed", "kept", "fail_bits")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read_table(spark, sf_dir, "documents"))


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
with ln as (select doc_id, source, text, generate_subscripts(ls, 1) as pos, unnest(ls) as line
            from (select doc_id, source, text, string_split(text, chr(10)) as ls from documents)),
w as (select *, regexp_matches(line, '[^\x20\x09-\x0D]') as wordy from ln),
b as (select line from w where wordy group by line having count(distinct source) >= 10),
m as (select w.*, wordy and b.line is not null as hit from w left join b on w.line = b.line),
t as (select doc_id, any_value(text) as text, count(*) filter (where wordy) as n_lines, count(*) filter (where hit) as gone,
             string_agg(line, chr(10) order by pos) filter (where not hit) as rest from m group by doc_id)
select doc_id, n_lines, gone as n_removed, sha256(case when gone > 0 then coalesce(rest, '') else text end) as text_sha256 from t
"""

OP7_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
                  string_split(coalesce(text, ''), chr(10)) as ls, coalesce(text, '') as t from documents),
b as (select doc_id, ws, t, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
             [x for x in ls if regexp_matches(x, '[^\x20\x09-\x0D]')] as wl,
             len([x for x in ws if regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]')]) as n_wordy from w),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
      from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from b)),
tw as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1),
rw as (select doc_id, count(distinct i + k) as n from tw, (select unnest([0, 1, 2]) as k) group by doc_id),
m as (select b.doc_id, n_words, word_chars, n_symbols, len(wl) - len(list_distinct(wl)) as n_dup_lines,
             len(wl) as n_lines, n_wordy, coalesce(rw.n, 0) as n_repeat_words from b left join rw on b.doc_id = rw.doc_id),
f as (select *, (case when n_words < 50 then 1 else 0 end)
    + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > n_words then 4 else 0 end)
    + (case when word_chars < 2 * n_words then 8 else 0 end)
    + (case when word_chars > 15 * n_words then 16 else 0 end)
    + (case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 32 else 0 end)
    + (case when 10 * n_wordy < 7 * n_words then 64 else 0 end)
    + (case when n_words > 1000000 then 128 else 0 end) as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed,
       (fail_bits & 127) = 0 as kept, cast(fail_bits as bigint) as fail_bits from f
"""

OP11_SQL = r"""
with recursive
enc as (select doc_id, source, text, coalesce(strlen(source) || ':' || source, '-') as s, coalesce(strlen(lang) || ':' || lang, '-') as g,
               coalesce(strlen(cast(n_chars as varchar)) || ':' || cast(n_chars as varchar), '-') as c,
               coalesce(strlen(cast(doc_id as varchar)) || ':' || cast(doc_id as varchar), '-') as i from documents),
leaves as (select doc_id, source, sha256(i || s || g || c || coalesce(strlen(text) || ':' || text, '-')) as leaf,
                  sha256(i || s || g || c || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) as cut
           from enc),
bits(doc_id, pos, size, crc) as (
    select doc_id, 1, length(cast(doc_id as varchar)), 4294967295::bigint from documents
    union all
    select doc_id, pos + 1, size, list_reduce(list_prepend(xor(crc, ascii(substr(cast(doc_id as varchar), pos, 1))::bigint), range(8)),
        lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)
    from bits where pos <= size),
odd as (select doc_id, xor(crc, 4294967295::bigint) % 2 = 0 as changed from bits where pos > size),
numbered as (select l.doc_id, source, leaf, case when changed then cut else leaf end as start,
                    row_number() over (partition by source order by l.doc_id) - 1 as pos, count(*) over (partition by source) as n
             from leaves l join odd o on l.doc_id = o.doc_id),
tree(source, lvl, i, d, n) as (
    select source, 0, pos, leaf, n from numbered
    union all
    select source, lvl + 1, i // 3, sha256(string_agg(d, '' order by i)), (n + 2) // 3 from tree where n > 1
    group by source, lvl, i // 3, n),
subroots as (select source, d, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from tree where n = 1),
top(lvl, i, d, n) as (
    select 0, pos, d, n from subroots
    union all
    select lvl + 1, i // 3, sha256(string_agg(d, '' order by i)), (n + 2) // 3 from top where n > 1 group by lvl, i // 3, n),
beside as (select source, lvl, i, coalesce(string_agg(d, '') over (run rows between unbounded preceding and 1 preceding), '') as l,
                  coalesce(string_agg(d, '') over (run rows between 1 following and unbounded following), '') as r
           from tree where n > 1 window run as (partition by source, lvl, i // 3 order by i)),
beside_top as (select lvl, i, coalesce(string_agg(d, '') over (run rows between unbounded preceding and 1 preceding), '') as l,
                      coalesce(string_agg(d, '') over (run rows between 1 following and unbounded following), '') as r
               from top where n > 1 window run as (partition by lvl, i // 3 order by i)),
walk(doc_id, source, lvl, i, n, d, proof) as (
    select doc_id, source, 0, pos, n, start, '' from numbered
    union all
    select w.doc_id, w.source, w.lvl + 1, w.i // 3, (w.n + 2) // 3, sha256(b.l || w.d || b.r), w.proof || b.l || b.r
    from walk w join beside b on b.source is not distinct from w.source and b.lvl = w.lvl and b.i = w.i where w.n > 1),
climb(doc_id, lvl, i, n, d, proof) as (
    select w.doc_id, 0, s.pos, s.n, w.d, w.proof from walk w join subroots s on w.source is not distinct from s.source where w.n = 1
    union all
    select c.doc_id, c.lvl + 1, c.i // 3, (c.n + 2) // 3, sha256(b.l || c.d || b.r), c.proof || b.l || b.r
    from climb c join beside_top b on b.lvl = c.lvl and b.i = c.i where c.n > 1)
select m.doc_id, m.leaf, s.d as subroot, t.d as root, sha256(c.proof) as proof_sha256, c.d as folded_root, c.d = t.d as verified
from numbered m join subroots s on m.source is not distinct from s.source join climb c on c.doc_id = m.doc_id and c.n = 1
     join top t on t.n = 1
"""

OP13_SQL = r"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q, row_number() over () as row
           from embeddings where vec_id is not null and label is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as anchor_id, a.row as a_row, b.vec_id, b.row, a.label = b.label as same,
             list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
      from v a join v b on a.row <> b.row where a.vec_id % 100 = 0),
p as (select anchor_id, a_row, vec_id as positive_id, row as p_row, score as positive_score from s where same
      qualify row_number() over (partition by a_row order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.a_row, p_row order by score desc, vec_id)::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join s on s.a_row = p.a_row and not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_byte_bpe, op4_token_files, op5_near_dedup, op6_token_counts, op7_quality_rules,
                             op8_toxicity, op9_suffix_repeats, op10_decontaminate, op11_merkle,
                             op12_lm_score, op13_hard_negatives)}
SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op7_quality_rules": OP7_SQL, "op11_merkle": OP11_SQL,
                       "op13_hard_negatives": OP13_SQL}
