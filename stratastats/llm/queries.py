"""The registered queries of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    balltree, curriculum, hosts, html_text, imatch, language, lines, neardup, negatives, pieces,
    quality, spelling, token_store,
)
from .common import id_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@_query("op1_quality")
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.train(docs, labels.filter(id_fold("doc_id", 5) != 0))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(id_fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@_query("op2_language")
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs.filter(id_fold("doc_id", 4) != 2))
    found = language.identify(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(id_fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"),
        "lang_pred",
        "score",
    )


@_query("op3_html_text")
def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


_OP4 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
pairs as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank
  from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@_query("op4_top_k", _OP4)
def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = balltree.quantised(table(spark, folder, "embeddings"), 256)
    return balltree.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@_query("op5_pieces")
def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pieces.digests(docs, public_tokenizers.path(PIECE_MODEL))


_OP6 = r"""
with l as (
  select doc_id, i, x as line,
         translate(trim(x, e' \t\n\v\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
        from documents)
),
common as (
  select key, max(doc_id) as largest from l where length(key) >= 40
  group by key having count(distinct doc_id) >= 5
)
select l.doc_id, count(*) as n_lines,
       count(*) filter (c.key is not null and l.doc_id <> c.largest) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i)
              filter (c.key is null or l.doc_id = c.largest), '')) as kept_sha256
from l left join common c on l.key = c.key
group by l.doc_id
""".replace(r"e' \t\n\v\f\r'", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)")


@_query("op6_line_dedup", _OP6)
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lines.digests(docs, lines.keep_bitmaps(docs))


@_query("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.components(table(spark, folder, "documents"), percent=85)


def weight_of(number: int, source: str | None) -> curriculum.Schedule:
    """Weights 3, 1, 2, repeating; every other source starts low and ends high, the rest fall."""
    w = float((3, 1, 2)[number % 3])
    low, high = (0.5 * w, 1.5 * w) if number % 2 else (1.5 * w, 0.5 * w)
    return [(0.0, low), (1.0, high)]


_OP8 = r"""
with d as (
  select doc_id, source, hash_key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from (select *, md5(coalesce(doc_id::varchar, '')) as hash_key from documents)
),
s as (
  select source, sum(size)::bigint as source_size,
         [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight,
         -- the share at the start; it falls or rises evenly to 2 less this at the end
         case when row_number() over (order by source nulls last) % 2 = 0 then 0.5::double else 1.5::double end as w0
  from d group by source
),
o as (
  select *, 2.0::double * source_size as cap,
         sum(source_size) over ()::double * 1.5::double as total,
         sum(2 * source_size) over (order by source_size / weight, source nulls last) - 2 * source_size as cap_before,
         sum(weight) over (order by source_size / weight desc, source desc nulls first) as weight_left
  from s
),
cut as (
  -- sources fill up in the order of size per weight; the rate is that of the first that does not
  select rate from (
    select (total - cap_before) / weight_left as rate, cap, weight, source, source_size from o
  ) where rate * weight <= cap
  order by source_size / weight, source nulls last limit 1
),
t as (
  select source, source_size, w0, case when rate * weight > cap then cap else rate * weight end as target
  from o, cut
),
run as (
  select d.doc_id, d.size, t.source_size, t.target, t.w0,
         sum(d.size) over (partition by d.source order by hash_key, d.doc_id) - d.size + size / 2.0::double as middle
  from d join t on d.source is not distinct from t.source
),
used as (
  select *, (middle < target)::int + (source_size + middle < target)::int as uses from run
),
demand as (
  select *, middle / target as d1, ((uses - 1) * source_size + middle) / target as d2 from used
)
select doc_id, size, source_size, target, (size * uses)::bigint as taken,
       case when uses > 0 then round(least(2 * d1 / (w0 + sqrt(w0 * w0 + 4 * (1 - w0) * d1)), 1.0::double), 9) end as position,
       case when uses > 0 then round(least(2 * d2 / (w0 + sqrt(w0 * w0 + 4 * (1 - w0) * d2)), 1.0::double), 9) end
         as last_position
from demand
"""


@_query("op8_curriculum", _OP8)
def op8_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    planned = curriculum.plan(table(spark, folder, "documents"), weight_of, volume=1.5, most=2.0)
    return curriculum.in_order(planned).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.round("position", 9).alias("position"), F.round("last_position", 9).alias("last_position"),
    )


@_query("op9_token_store")
def op9_token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = token_store.write(docs, public_tokenizers.path(BYTE_MODEL), end_id=2)
    return token_store.entries(spark, path)


@_query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return imatch.edited_digests(docs, imatch.lexicon(docs))


_OP11 = r"""
with d as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents
),
m as (
  select rid, doc_id, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from d
),
windows as (
  select rid, i, array_to_string(words[i:i + 7], ' ') as w
  from (select rid, words, unnest(range(1, len(words) - 6)) as i from m where len(words) >= 8)
),
twice as (
  select rid, i - lag(i, 1, -1000) over (partition by rid order by i) as step
  from (select rid, i, count(*) over (partition by rid, w) as c from windows) where c > 1
),
covered as (select rid, sum(least(8, step))::bigint as n from twice group by rid),
counts as (
  select rid, doc_id, source, len(words)::bigint as n_words,
         length(array_to_string(words, ''))::bigint as word_chars, n_symbols::bigint as n_symbols,
         len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words
  from m left join covered c using (rid)
),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
         100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 30 * n_lines
           or 100 * word_chars > 1000 * n_words or 100 * word_chars < 300 * n_words as tight,
         100 * n_symbols > 50 * n_words or 100 * n_dup_lines > 60 * n_lines
           or 100 * word_chars > 1500 * n_words or 100 * word_chars < 200 * n_words as wide
  from counts
),
h as (
  select source, count(*)::double as n, count(*) filter (base_failed or tight)::double as f
  from judged group by source
),
p as (
  select sum(n) as n, sum(f) / sum(n) as p, sum(n * n) as nn,
         sum(f * f / n) - sum(f) * sum(f) / sum(n) as spread, count(source) - 1.0::double as many
  from h
),
g as (
  select *, (spread - p * (1 - p) * many) / nullif(p * (1 - p) * (n - nn / n - many), 0) as between_hosts from p
),
prior as (
  select p, case when between_hosts > 0 then least(greatest(1 / between_hosts - 1, 0), n) else n end as weight
  from g
),
rates as (
  select source, case when source is null then p else (f + p * weight) / (h.n + weight) end as rate
  from h, prior
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not wide and rate < 0.5 and not (rate >= 0.25 and tight) as kept,
       round(rate, 6) as host_rate,
       case when rate >= 0.5 then 'blocked' when rate >= 0.25 then 'strict' else 'trusted' end as host_verdict
from judged j join rates r on j.source is not distinct from r.source
"""


@_query("op11_host_rules", _OP11)
def op11_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = hosts.judged(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"), "host_verdict",
    )


@_query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.counted_words(table(spark, folder, "documents"), misspell=31)
    return spelling.variants(words, times=10)


_OP13 = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as alike,
         list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::bigint as score
  from e a join e r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id and len(a.v) = len(r.v)
),
positives as (
  select * from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score,
       n.score as negative_score,
       row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::int as rank
from positives p join scored n on p.anchor_id = n.anchor_id and not n.alike
     and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5
"""


@_query("op13_hard_negatives", _OP13)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.quantised(table(spark, folder, "embeddings"), 256, label=label)
    return negatives.hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"))
