"""The training-data queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, fingerprint, language, lines, mixing, near, packing, secrets, substrings, tokencount
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mix of all documents: words taken of each."""
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"), quality=mixing.quality_weights(table(spark, sf_dir, "labels")))
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP1_SQL = r"""
with best as (select doc_id, max(quality) as q from labels where doc_id is not null group by doc_id),
base as (
  select d.doc_id, d.source,
    coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5e0) / pow(2e0, 52))
      / (case when b.q >= 1 then 2e0 when b.q < 1 then 0.5e0 else 1e0 end) as k
  from documents d left join best b on d.doc_id = b.doc_id),
sizes as (select source, sum(size)::bigint as source_size from base group by source),
numbered as (select *, row_number() over (order by source nulls last) - 1 as no from sizes),
weighed as (select *, case no % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 2e0 as cap from numbered),
levels as (
  select *, (sum(source_size) over () * 1.5e0 - coalesce(sum(cap) over (order by cap / weight, no rows between unbounded preceding and 1 preceding), 0e0))
    / sum(weight) over (order by cap / weight, no rows between current row and unbounded following) as lev,
    row_number() over (order by cap / weight, no) as place
  from weighed),
level as (select min_by(lev, place) as lev from levels where cap / weight >= lev),
targets as (select s.source, s.source_size, coalesce(least(s.cap, l.lev * s.weight), s.cap) as target from levels s left join level l on true),
split as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from targets),
run as (
  select b.doc_id, b.size, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size as rest,
    sum(b.size) over (partition by b.source order by b.k, b.doc_id nulls first, b.size rows between unbounded preceding and current row) as upto
  from base b join split t on b.source is not distinct from t.source)
select doc_id, size, source_size, round(target, 6) as target,
  (size * (epochs + case when rest > 0 and (upto <= rest or upto - rest < rest - (upto - size)) then 1 else 0 end))::bigint as taken
from run
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked secret spans of every document."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def _duck_spans(name: str, pattern: str, kind: int, keep: str, group: int = 0) -> str:
    """DuckDB's form of the spans of a pattern: lengths of pieces and matches, added up."""
    p = pattern.replace("'", "''")
    return f"""
{name}_m as (
  select r, unnest(regexp_split_to_array(t, '{p}')) as g, unnest(list_append(regexp_extract_all(t, '{p}'), null)) as m,
    unnest(list_append(regexp_extract_all(t, '{p}', {group}), null)) as o, generate_subscripts(regexp_split_to_array(t, '{p}'), 1) as i
  from d where regexp_matches(t, '{p}')),
{name} as (
  select r, (e - length(m))::int as s, {kind} as k, e::int as e
  from (select r, m, o, sum(length(g) + coalesce(length(m), 0)) over (partition by r order by i) as e from {name}_m)
  where m is not null and {keep})"""


_PLAIN_ASSIGN = secrets.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
OP2_SQL = f"""
with d as (select row_number() over (order by doc_id) as r, doc_id, coalesce(text, '') as t from documents),
{_duck_spans("a", _PLAIN_ASSIGN, 0, "length(o) >= 12", 2)},
{_duck_spans("c", secrets.ACCESS, 1, "true")},
{_duck_spans("h", secrets.HEX, 2, "true")},
{_duck_spans("wa", _PLAIN_ASSIGN, 3, "length(o) >= 6 and length(o) < 12", 2)},
{_duck_spans("wc", secrets.SHORT_ACCESS, 4, "length(o) >= 12 and length(o) < 18")},
{_duck_spans("wn", secrets.NAMED_ACCESS, 4, "true", 1)},
{_duck_spans("wt", secrets.TOKEN, 5, "regexp_matches(o, '[a-z]') and regexp_matches(o, '[A-Z]') and regexp_matches(o, '[0-9]') and not starts_with(o, 'AKIA')")},
{_duck_spans("we", secrets.ENDPOINT, 6, "true")},
base as (select * from a union all select * from c union all select * from h),
weak as (select distinct * from (select * from wa union all select * from wc union all select * from wn union all select * from wt union all select * from we) w
  where not exists (select 1 from base b where b.r = w.r and b.s <= w.s and w.e <= b.e)),
every as (select *, case when k in (1, 4) then 1 when k = 6 then 2 else 0 end as role from (select * from base union all select * from weak)),
linked as (select w.r, w.s, w.k, w.e from every w where w.k >= 3 and exists (select 1 from every o
  where o.r = w.r and o.s <= w.e + {secrets.SCOPE} and w.s <= o.e + {secrets.SCOPE} and o.role <> w.role and (o.role = 0 or w.role = 0))),
names as (select unnest(['assign', 'access', 'hex', 'weak_assign', 'weak_access', 'weak_token', 'endpoint']) as name, unnest(range(7)) as k),
b as (select r, count(*) filter (where k = 0) as na, count(*) filter (where k = 1) as nc, count(*) filter (where k = 2) as nh,
  string_agg(name || ':' || s || ':' || e, ',' order by s, k, e) as spans from base join names using (k) group by r),
l as (select r, count(*) as n from linked group by r),
x as (select r, string_agg(name || ':' || s || ':' || e, ',' order by s, k, e) as spans from (select * from base union all select * from linked) join names using (k) group by r)
select doc_id, coalesce(na, 0) as n_assign, coalesce(nc, 0) as n_access, coalesce(nh, 0) as n_hex, sha256(coalesce(b.spans, '')) as base_sha256,
  coalesce(x.spans, '') as spans, coalesce(l.n, 0) as n_linked
from d left join b using (r) left join l using (r) left join x using (r)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    out = model.predict(docs.select("doc_id", "text"))
    held_out = F.coalesce(language.remainder(F.col("row.doc_id")) == 2, F.lit(False))
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical texts, by block naming."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).drop("txt")


OP4_SQL = """
with d as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id) as r from documents)
select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
  row_number() over (partition by text order by doc_id desc nulls last, r) = 1 as kept, sha256(text) as text_sha256
from d
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets share 80 per cent or more."""
    found = near.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 35-word runs that also start elsewhere."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near documents by the bands of their fingerprints, verified on full sets (5-word shingles, 80 per cent)."""
    found = fingerprint.near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("group", F.concat(F.lit("none "), F.col("doc_id").cast("string"))).alias("group"))
    first = found.groupBy("group").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    return found.join(first, "group").select("doc_id", "first_id", "size")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of templates that recur across documents."""
    return lines.drop_template_lines(table(spark, sf_dir, "documents"))


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 4096 tokens, packed into sequences."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after three edits of each: an insertion, a deletion and a replacement."""
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.length("text"), F.lit(0))
    third = F.floor(n / 3).cast("int")
    edits = F.array(
        F.struct(third.alias("start"), third.alias("end"), F.lit(" an inserted phrase,").alias("new")),
        F.struct((2 * third).alias("start"), (2 * third + 24).alias("end"), F.lit("").alias("new")),
        F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("Opening").alias("new")),
    )
    return tokencount.count_edits(docs, edits)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_secret_scan": op2_secret_scan,
        "op3_language_id": op3_language_id,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_near_dedup": op5_near_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_fingerprints": op7_fingerprints,
        "fingerprint_groups": fingerprint_groups,
        "op8_line_dedup": op8_line_dedup,
        "op9_pack_documents": op9_pack_documents,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": OP1_SQL,
        "op2_secret_scan": OP2_SQL,
        "op4_exact_dedup": OP4_SQL,
    }
