"""Queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontam, lines, minhash, mixing, packing, pages, passages, phrases, quality, tokenfile, topk, toxicity
from .common import load


def word_count() -> Column:
    """Words of a text for the mix: runs of other characters than ASCII white space."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op2_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    return quality.classified(docs, quality.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op3_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.decisions(load(spark, sf_dir, "documents"))


def op5_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(load(spark, sf_dir, "documents"))


def op7_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    return toxicity.classified(docs, toxicity.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op8_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extracted(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark")
    return decontam.judged(decontam.overlaps(docs, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("_n"))
    held = mixing.assigned(docs, F.col("_n"))
    step = F.floor(F.get("positions", F.lit(0)) * mixing.STEPS).cast("long")
    return held.select("doc_id", "size", "source_size", "target", "taken", step.alias("first_step"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.token_output(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations all of whose turns are dropped have zeros, no edits and the digest of an empty string."""
    rows = load(spark, sf_dir, "conversations")
    made = conversations.repaired(conversations.damaged(rows)).withColumnRenamed("conv_id", "_c")
    out = rows.select("conv_id").distinct().join(made, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    blank = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return out.select("conv_id", *[F.coalesce(F.col(c), blank.get(c, F.lit(0))).alias(c) for c in out.columns if c != "conv_id"])


def op13_pivot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(load(spark, sf_dir, "documents").select("lang", "text"))


_ALL = (op1_dart_minhash, op2_byte_convnet, op3_line_edit_join, op4_decontamination, op5_chained_passages, op6_curriculum_mix, op7_noisy_or_toxicity, op8_page_templates, op9_token_files, op10_exact_topk, op11_best_fit_packing, op12_turn_repair, op13_pivot_phrases)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_OP4 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
i as (select item_id, w, least(13, len(w)) as n from b where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as s from i)),
dw as (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from i) where len(w) >= n)),
h as (select dw.doc_id, dw.s, dw.n, iw.item_id from dw join iw on dw.n = iw.n and dw.g = iw.g),
p as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(s, s + n)) as place from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join p using (doc_id) left join t using (doc_id)
"""

_OP6 = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as h from documents),
s as (select source, sum(size) as source_size, row_number() over (order by source is null, source) - 1 as rank from d group by source),
w as (select *, case rank % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as cap,
  case rank % 3 when 0 then 1.0::double when 1 then 1.5::double else 0.5::double end as a, case rank % 3 when 0 then 0.0::double when 1 then -1.0::double else 1.0::double end as b from s),
l as (select *, (cast(sum(source_size) over () as double) * 1.5::double - cast(coalesce(sum(cap) over before, 0) as double)) / cast(sum(weight) over () - coalesce(sum(weight) over before, 0) as double) as level
  from w window before as (order by cast(cap as double) / cast(weight as double), rank rows between unbounded preceding and 1 preceding)),
k as (select arg_min(level, {'r': cast(cap as double) / cast(weight as double), 'k': rank}) as level from l where cast(cap as double) >= level * weight),
t as (select source, source_size, coalesce(least(cast(cap as double), k.level * weight), cast(cap as double)) as target, a, b from l, k),
c as (select d.*, cast(coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as before from d),
m as (select doc_id, size, cast(source_size as bigint) as source_size, target, a, b, cast(before as double) + size / 2.0::double as y1, cast(before + source_size as double) + size / 2.0::double as y2
  from c join t on c.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(case when size = 0 then 0 else size * ((y1 <= target)::int + (y2 <= target)::int) end as bigint) as taken,
  case when size > 0 and y1 <= target then cast(floor((case when b = 0 then y1 / target * (a + b / 2) / a else (sqrt(a * a + 2 * b * (y1 / target * (a + b / 2))) - a) / b end) * 1000000) as bigint) end as first_step
from m
"""

_OP10 = r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, cast(list_dot_product(q.v, d.v) as bigint) as score from (select * from v where vec_id % 50 = 0) q join v d on q.vec_id <> d.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

_OP12 = r"""
with recursive crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
x as (select k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda b: ascii(b))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 as x from k, crc),
d as (select conv_id, turn, case when x = 4 then 'user' else role end as role, case x when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case x when 3 then 2 else 1 end)) as copy from x where x <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as bare, role[1] as h from d),
s as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as seen from o),
f as (select *, bare = '' as blank, bare <> '' and seen as duplicate, bare <> '' and not seen and right(bare, 1) not in ('.', '!', '?') as truncated, lag(h) over (partition by conv_id order by i) || h not in ('su', 'ua', 'au') as illegal from s),
n as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated, count(*) filter (illegal) as illegal from f group by conv_id),
p(conv_id, i, b) as (
  select conv_id, cast(0 as bigint), [{'s': 0, 'c': 0, 'a': ''}] from n
  union all
  select conv_id, i, list_filter(list_transform(range(4), lambda s: list_min(list_transform(list_filter(m, lambda y: y.s = s), lambda y: {'c': y.c, 'a': y.a, 's': y.s}))), lambda y: y is not null) from (
    select conv_id, i, list_transform(list_concat(list_transform(q, lambda y: {'s': y.s, 'c': y.c + 4, 'a': y.a || 'D'}), case when blank or duplicate then [] else list_concat(
      list_transform(list_filter(q, lambda y: h = 's' and y.s = 0 or h = 'u' and y.s <> 2 or h = 'a' and y.s = 2), lambda y: {'s': case h when 's' then 1 when 'u' then 2 else 3 end, 'c': y.c + 3 * truncated::int, 'a': y.a || 'K'}),
      list_transform(q, lambda y: {'s': case when y.s = 2 then 3 else 2 end, 'c': y.c + 3 + 3 * truncated::int, 'a': y.a || 'R'})) end), lambda y: y) as m
    from (select p.conv_id, f.i, f.h, f.blank, f.duplicate, f.truncated,
        list_concat(b, list_transform(b, lambda y: {'s': case when y.s = 2 then 3 else 2 end, 'c': y.c + 3, 'a': y.a || 'I'}), list_transform(b, lambda y: {'s': case when y.s = 2 then 2 else 3 end, 'c': y.c + 6, 'a': y.a || 'II'})) as q
      from p join f on f.conv_id is not distinct from p.conv_id and f.i = p.i + 1))),
e as (select n.*, list_min(list_transform(list_filter(list_concat(list_transform(b, lambda y: {'s': y.s, 'c': y.c, 'a': y.a}), list_transform(b, lambda y: {'s': case when y.s = 2 then 3 else 2 end, 'c': y.c + 3, 'a': y.a || 'I'}), list_transform(b, lambda y: {'s': case when y.s = 2 then 2 else 3 end, 'c': y.c + 6, 'a': y.a || 'II'})), lambda y: y.s in (0, 3)), lambda y: {'c': y.c, 'a': y.a})) as best
  from n join p on p.conv_id is not distinct from n.conv_id and p.i = n.n),
u as (select conv_id, unnest(string_split(best.a, '')) as edit, unnest(range(len(best.a))) as pos from e where best.a <> ''),
v as (select *, count(*) filter (edit <> 'I') over (partition by conv_id order by pos) as i from u),
g as (select v.conv_id, pos, edit, f.role, f.text, f.h, row_number() over (partition by v.conv_id order by pos) as place from v left join f on f.conv_id is not distinct from v.conv_id and f.i = v.i where edit <> 'D'),
l as (select conv_id, pos, case when edit = 'K' then role when (place - max((edit = 'K' and h = 's')::int) over (partition by conv_id)) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end as line from g),
j as (select conv_id, string_agg(line, chr(10) order by pos) as t from l group by conv_id)
select c.conv_id, coalesce(e.gaps, 0) as gaps, coalesce(e.blank, 0) as blank, coalesce(e.duplicate, 0) as duplicate, coalesce(e.truncated, 0) as truncated, coalesce(e.illegal, 0) as illegal, cast(coalesce(e.best.c, 0) as bigint) as cost, coalesce(e.best.a, '') as audit, sha256(coalesce(j.t, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join e on e.conv_id is not distinct from c.conv_id left join j on j.conv_id is not distinct from c.conv_id
"""

_OP13 = r"""
with p as (select coalesce(lang, 'und') as lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
t as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
o as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as s from w, (select unnest(range(1, 6)) as k) where len(w) >= k),
g as (select lang, k, w[s : s + k - 1] as g, cast(count(*) as bigint) as f from o group by all having count(*) >= 100),
d as (select distinct x.lang, x.g from g x join g y on x.lang = y.lang and y.k = x.k + 1 and (y.g[: x.k] = x.g or y.g[2 :] = x.g) where x.f <= y.f),
c as (select g.lang, g.g, g.f as a, g.k, unnest(range(1, g.k)) as cut from g left join d on d.lang = g.lang and d.g = g.g where g.k > 1 and d.g is null),
s as (select c.lang, c.g, c.a, c.cut, x.f as l, y.f as r, t.n, cast(1000::hugeint * c.a * t.n // (cast(x.f as hugeint) * y.f) as bigint) as score
  from c join g x on x.lang = c.lang and x.g = c.g[: c.cut] join g y on y.lang = c.lang and y.g = c.g[c.cut + 1 :] join t on t.lang = c.lang),
b as (select * from s qualify row_number() over (partition by lang, g order by score, cut) = 1),
r as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase, a, l, r, n, score from b)
select * from r where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_turn_repair": _OP12, "op13_pivot_phrases": _OP13, "op4_decontamination": _OP4, "op6_curriculum_mix": _OP6, "op10_exact_topk": _OP10}
