"""Queries on answers of completions and on the adapters of source rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, text
from ..operators import adapters
from ..registry import query
from .views import table

# Completions: the turns of conversations, whose text goes on in one of nine ways.
_FORMS = r"""x as (select conv_id, turn, case when (conv_id + turn) % 4 = 1 then 'length' else 'eos' end as finish, replace(coalesce(text, ''), chr(13), ' ') || case (conv_id + turn) % 9
  when 0 then chr(10) || 'Final answer: ' || conv_id when 1 then ' so we get \boxed{\frac{' || turn || '}{' || conv_id || '}} here' when 2 then chr(10) || conv_id || ',' || turn
  when 3 then chr(10) || 'Therefore it costs $' || turn || '.50 now' when 4 then chr(10) || '## Answer:' || chr(10) || '$ a = ' || conv_id || ' $' when 5 then chr(10) || '$x = ' || turn || '$'
  when 6 then ' \boxed{' || turn when 7 then chr(10) || 'Answer: yes.' else '' end as t from conversations)"""
_SCALAR = r"(?i)(?:[$£€]\s*)?[-+]?\s*(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:\s*/\s*[-+]?\s*(?:\d[\d,]*(?:\.\d+)?|\.\d+))?%?"


def _value(v: str) -> str:
    """DuckDB's form of the answer in a stretch of text."""
    formula = rf"list_extract(regexp_extract_all({v}, '\$([^$]+)\$', 1), -1)"
    return rf"""case when len(regexp_extract_all({v}, '\$([^$]+)\$', 1)) > 0 then case when contains({formula}, '=') and trim(list_extract(string_split({formula}, '='), -1)) <> '' then trim(list_extract(string_split({formula}, '='), -1)) else trim({formula}) end
 when len(regexp_extract_all({v}, '{_SCALAR}')) > 0 then trim(list_extract(regexp_extract_all({v}, '{_SCALAR}'), -1))
 else nullif(rtrim(regexp_extract({v}, '(?i)\b(?:undefined|true|false|yes|no|[A-E])\b[.!]?\s*$'), '.! '), '') end"""


_CLAIM = r"(?i)\b(?:therefore|thus|hence|so|consequently|we\s+(?:can\s+now\s+)?conclude|the\s+(?:final\s+)?(?:answer|result|solution|value|expression|remainder)|as\s+the\s+answer\s+must\s+be|this\s+implies|there\s+are)\b"
_ALONE = r"(?i)(?:[-+$£€]?\s*[\d,./%]+|[-+]?\\frac\s*\{[^{}]+\}\s*\{[^{}]+\}|[-+]?\\sqrt\s*\{[^{}]+\}|[-+]?\s*[a-z]\s*=\s*[^\n]+|\([^\n]{1,120}\)|\[[^\n]{1,120}\]|True|False|yes|no|[A-E])"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(trim(l), '\.$', ''), '^\$\$?', ''), '\$\$?$', '')"
_PARSED = rf"""{_FORMS}, m as (select *, list_extract(regexp_extract_all(t, '\\boxed\s*\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}', 1), -1) as box, len(regexp_extract_all(t, '\\boxed\s*\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}', 1)) as boxes, len(regexp_extract_all(t, '\\boxed\s*\{{')) as opened,
  list_extract(regexp_extract_all(t, '(?im)^\s*(?:#{{1,6}}\s*)?(?:final\s+answer|answer)\s*:?[ \t]*(.*(?:\n\$[^\n]*)?)$', 1), -1) as mark,
  list_extract(list_filter(string_split(rtrim(t), chr(10)), lambda l: trim(l) <> '' and length(trim(l)) <= 160 and regexp_full_match(trim({_BARE}), '{_ALONE}')), -1) as line,
  list_extract(string_split(rtrim(t), chr(10)), -1) as last from x),
 v as (select *, {_value("mark")} as marked, trim({_BARE.replace("(l)", "(line)")}) as alone,
  case when length(last) <= 700 and regexp_matches(last, '{_CLAIM}') then {_value(f"substr(last, strpos(last, regexp_extract(last, '{_CLAIM}')))")} end as claimed from m),
 a as (select *, case when box is not null then 'last_boxed' when marked is not null then 'final_answer_marker' when line is not null then 'isolated_answer_line' when claimed is not null then 'final_assertion' else 'none' end as method,
  coalesce(trim(box), marked, case when line is not null then alone end, claimed) as parsed_answer from v)"""


def completions(spark, d):
    c = table(spark, d, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 9
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    forms = [
        F.concat(F.lit("\nFinal answer: "), conv), F.concat(F.lit(" so we get \\boxed{\\frac{"), turn, F.lit("}{"), conv, F.lit("}} here")), F.concat(F.lit("\n"), conv, F.lit(","), turn), F.concat(F.lit("\nTherefore it costs $"), turn, F.lit(".50 now")),
        F.concat(F.lit("\n## Answer:\n$ a = "), conv, F.lit(" $")), F.concat(F.lit("\n$x = "), turn, F.lit("$")), F.concat(F.lit(" \\boxed{"), turn), F.lit("\nAnswer: yes."), F.lit(""),
    ]
    end = F.coalesce(*[F.when(k == i, x) for i, x in enumerate(forms)])
    finish = F.when((F.col("conv_id") + F.col("turn")) % 4 == 1, "length").otherwise("eos")
    return c.select("conv_id", "turn", finish.alias("finish"), F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")), end).alias("t"))


@query("answer_parse", "STR13 STR14 STR15 STR16 STR17 STR18 STR19 STR20", f"""with {_PARSED} select conv_id, turn, method, parsed_answer, opened > boxes as unclosed, case method when 'last_boxed' then 1 when 'final_answer_marker' then 2 when 'isolated_answer_line' then 4 when 'final_assertion' then 6 else 0 end::int as rule_priority,
 method <> 'none' and (finish <> 'length' or method in ('last_boxed', 'final_answer_marker')) as acceptable from a""")
def answer_parse(spark, d):
    r = completions(spark, d).withColumn("r", answers.answer_region(F.col("t")))
    return r.select("conv_id", "turn", "r.method", "r.parsed_answer", answers.unclosed_box(F.col("t")).alias("unclosed"), F.coalesce("r.rule_priority", F.lit(0)).alias("rule_priority"), answers.acceptable(F.col("r"), F.col("finish")).alias("acceptable"))


@query("answer_places", "STR19")
def answer_places(spark, d):
    """All fields of the parsed regions; compared with slices of the texts in tests."""
    r = completions(spark, d).withColumn("r", answers.answer_region(F.col("t")))
    return r.select("conv_id", "turn", "r.*")


@query("failure_classes", "STR31", rf"""with {_PARSED}, f as (select *, trim(coalesce(list_extract(regexp_extract_all(t, '(?im)^\s*(?:final\s+answer|answer)\s*:\s*(.*)$', 1), -1), '')) as marker,
  trim(list_extract(list_filter(string_split(t, chr(10)), lambda l: trim(l) <> ''), -1)) as final,
  trim(regexp_extract(rtrim(t), '(?is)(?:therefore|thus|hence|so|consequently)?\s*,?\s*(?:the\s+)?(?:final\s+)?(?:answer|result|value)\s+is\s*:?[ \t]*([^\n]+)\s*$', 1)) as phrase from a),
 g as (select case when method = 'last_boxed' then 'complete boxed answer parsed correctly' when boxes > 0 then 'complete boxed answer missed' when marker <> '' then 'answer written after Final answer:'
  when regexp_matches(t, '(?im)^\s*answer\s*:') then 'answer written after Answer:'
  when length(final) <= 180 and regexp_full_match(final, '(?i)(?:[-+$£€]?\s*[\d,]+(?:\.\d+)?(?:\s*/\s*[-+]?\d+(?:\.\d+)?)?%?|\\?[a-z]+(?:\s*\{{[^\n]+\}})?|\$[^\n$]+\$|\([^\n]{{1,120}}\)|true|false|yes|no|[A-E])') then 'answer given as final isolated line'
  when phrase <> '' then 'valid answer in another common deterministic format' when opened > boxes then 'malformed or unclosed box' when finish = 'length' then 'output-length limit reached' when finish = 'eos' then 'response ended at EOS without final answer'
  else 'no final answer despite sufficient generation budget' end as category from f)
 select category, count(*) as n from g group by category""")
def failure_classes(spark, d):
    r = completions(spark, d).withColumn("r", answers.answer_region(F.col("t")))
    return r.select(answers.failure_category(F.col("t"), F.col("r"), F.col("finish")).alias("c")).groupBy("c.category").agg(F.count(F.lit(1)).alias("n"))


@query("reasoning_regions", "STR35 STR34", f"""with {_PARSED}, s as (select conv_id, turn, t, case when method = 'final_answer_marker' then length(regexp_extract(t, '(?is)^(.*?)(?:\\n|^)\\s*(?:#{{1,6}}\\s*)?(?:final\\s+answer|answer)\\s*:[^\\n]*\\n?[^\\n]*$', 1)) end as ahead from a where method = 'final_answer_marker' and turn >= 0)
 select conv_id, turn, len(regexp_extract_all(substr(t, 1, ahead), '\\S+'))::int as token_end from s""")
def reasoning_regions(spark, d):
    r = completions(spark, d).withColumn("r", answers.answer_region(F.col("t"))).where(F.col("r.method") == "final_answer_marker")
    return r.select("conv_id", "turn", answers.reasoning_split(F.col("t"))["token_end"].alias("token_end"))


@query("step_borders", "STR36 STR29", r"""with s as (select doc_id, string_split(text, chr(10)) as steps from documents where text is not null), r as (select doc_id, unnest(steps) as step, generate_subscripts(steps, 1) as i from s)
 select doc_id, count(*) as steps, sum(length(step) + 2)::bigint - 1 as total, count(*) filter (where trim(step) <> '' and not regexp_matches(step, '\s$')) as exact from r group by doc_id""")
def step_borders(spark, d):
    s = table(spark, d, "documents").where("text is not null").select("doc_id", answers.step_audit(F.split("text", "\n", -1)).alias("a"), F.split("text", "\n", -1).alias("steps"))
    exact = F.size(F.filter(F.arrays_zip("a", "steps"), lambda x: x["a"]["exact"] & (F.trim(x["steps"]) != "")))
    total = F.element_at("a", -1)["requested"].cast("long")
    return s.select("doc_id", F.size("a").cast("long").alias("steps"), total.alias("total"), exact.cast("long").alias("exact"))


@query("final_split", "STR12 STR30", r"""with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) || [case when doc_id % 2 = 0 then 'Answer: ' || doc_id || '.' else 'so ' || doc_id end] as steps, case when doc_id % 3 = 0 then doc_id::varchar end as explicit from documents),
 p as (select doc_id, case when explicit is null then len(steps) - 1 else len(steps) end as n_steps, coalesce(explicit, list_extract(steps, -1)) as answer, list_extract(steps, -1) as last from s)
 select doc_id, n_steps, answer, regexp_replace(lower(regexp_replace(trim(last), '(?i)^(?:final\s+answer|answer|the\s+final\s+answer\s+is)\s*[:=]?\s*', '')), '\.+$', '') = doc_id::varchar as answer_only from p""")
def final_split(spark, d):
    own = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Answer: "), F.col("doc_id").cast("string"), F.lit("."))).otherwise(F.concat(F.lit("so "), F.col("doc_id").cast("string")))
    s = table(spark, d, "documents").select("doc_id", F.concat(F.split(F.coalesce("text", F.lit("")), "\n", -1), F.array(own)).alias("steps"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).alias("explicit"))
    p = s.withColumn("p", text.split_final(F.col("steps"), F.col("explicit")))
    return p.select("doc_id", F.size("p.steps").cast("long").alias("n_steps"), "p.answer", answers.answer_only(F.element_at("steps", -1), F.col("doc_id").cast("string")).alias("answer_only"))


@query("prompts", "STR38", r"""select item_id, case item_id % 3 when 0 then 'Solve the problem step by step. Put your final answer in \boxed{}.' when 1 then 'Solve the problem step by step. Put each major reasoning step in a separate paragraph. Put your final answer in \boxed{}.'
 else 'Solve the problem in numbered reasoning steps. Put your final answer in \boxed{}.' end || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') as prompt from benchmark""")
def prompts(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", answers.prompt(F.col("text"), F.concat(F.lit("P"), (F.col("item_id") % 3).cast("string"))).alias("prompt"))


@query("reference_answers", "STR23", r"""with s as (select p_partkey, ['gsm8k', 'math', 'olympiadbench', 'omnimath'][p_partkey % 4 + 1] as source, case when p_partkey % 4 = 0 then p_name || chr(10) || '#### ' || p_size || ',' || p_partkey || ' ' when p_partkey % 8 = 3 then p_name end as answer,
  p_name || ' \boxed{' || p_type || '} and \boxed{{' || p_brand || '}}' as solution, p_brand as final_answer from part)
 select p_partkey, source, case source when 'gsm8k' then replace(trim(regexp_extract(answer, '####\s*([^\n]+)\s*$', 1)), ',', '') when 'math' then list_extract(regexp_extract_all(solution, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1), -1) else coalesce(answer, final_answer) end as reference from s""")
def reference_answers(spark, d):
    k = F.col("p_partkey")
    source = F.element_at(F.array(*map(F.lit, ("gsm8k", "math", "olympiadbench", "omnimath"))), (k % 4 + 1).cast("int"))
    marked = F.concat("p_name", F.lit("\n#### "), F.col("p_size").cast("string"), F.lit(","), k.cast("string"), F.lit(" "))
    solution = F.concat("p_name", F.lit(" \\boxed{"), "p_type", F.lit("} and \\boxed{{"), "p_brand", F.lit("}}"))
    s = table(spark, d, "part").select(k, source.alias("source"), F.when(k % 4 == 0, marked).when(k % 8 == 3, F.col("p_name")).alias("answer"), solution.alias("solution"), F.col("p_brand").alias("final_answer"))
    return s.select("p_partkey", "source", answers.reference_answer(F.col("source"), F.col("answer"), F.col("solution"), F.col("final_answer")).alias("reference"))


_SOURCES = "['Qwen/ProcessBench', 'facebook/CRV', 'other']"
_SUBSETS = "['math', 'OlympiadBench', 'omni-math', 'arithmetic_expressions', 'gsm8k', 'x/math', 'Arith.1']"


def _sources(k):
    one = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return one(("Qwen/ProcessBench", "facebook/CRV", "other"), k % 3), one(("math", "OlympiadBench", "omni-math", "arithmetic_expressions", "gsm8k", "x/math", "Arith.1"), k % 7)


_BUCKET = """case when lower(d) like '%facebook/crv%' and (replace(lower(s), '-', '_') like '%arithmetic%' or starts_with(replace(lower(s), '-', '_'), 'arith.')) then 'crv_arithmetic' when lower(d) not like '%processbench%' then null
 when lower(s) like '%olympiad%' then 'processbench_olympiadbench' when replace(lower(s), '-', '_') like '%omnimath%' or replace(lower(s), '-', '_') like '%omni_math%' then 'processbench_omnimath' when lower(s) = 'math' or lower(s) like '%/math' then 'processbench_math' end"""


@query("source_buckets", "STR24", f"with x as (select {_SOURCES}[o_orderkey % 3 + 1] as d, {_SUBSETS}[o_orderkey % 7 + 1] as s from orders), b as (select {_BUCKET} as bucket from x) select bucket, count(*) as n from b group by bucket")
def source_buckets(spark, d):
    dataset, subset = _sources(F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy(answers.source_bucket(dataset, subset).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("labelled_rows", "FIL01 FIL03", r"""with s as (select doc_id, nullif(split_part(coalesce(text, ''), ' ', 1), 'The') as problem, case when doc_id % 11 <> 5 then string_split(coalesce(text, ''), chr(10)) end as steps, doc_id % 7 - 2 as label, case when doc_id % 13 <> 0 then doc_id % 2 = 0 end as correct from documents),
 r as (select *, array_to_string(list_filter([case when correct is null then 'final_answer_correct' end, case when problem is null then 'problem' end, case when steps is null then 'steps' end], lambda x: x is not null), ', ') as missing from s)
 select case when missing <> '' then 'missing fields: ' || missing when problem = '' then 'empty id or problem' when label >= len(steps) then 'first error outside the steps' end as reason, count(*) as n,
  coalesce(sum(case when label >= 0 then label end), 0)::bigint as errors, count(*) filter (where label >= 0) as wrong from r group by 1""")
def labelled_rows(spark, d):
    k = F.col("doc_id")
    first = F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1))
    s = table(spark, d, "documents").select(
        k.alias("id"), F.when(first != "The", first).alias("problem"), F.when(k % 11 != 5, F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("steps"), (k % 7 - 2).alias("label"), F.when(k % 13 != 0, k % 2 == 0).alias("final_answer_correct"),
        F.lit("7").alias("final_answer"), F.col("source").alias("generator"), F.lit(None).cast("string").alias("reference_answer"),
    )
    t = adapters.labelled_steps(s, "math")
    return t.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("first_error_index"), F.lit(0)).alias("errors"), F.count_if(F.col("index_base") == "zero").alias("wrong"))


@query("expression_rows", "FIL02", """with s as (select p_partkey as k, case when p_partkey % 5 <> 0 then p_name end as e, case when p_partkey % 10 <> 0 then p_type else '' end as q, list_transform(range(p_size % 4), lambda i: case when (i + p_partkey) % 6 = 0 then null else (i + p_partkey) % 3 <> 0 end) as labels,
  p_size as correct, case when p_partkey % 9 <> 4 then p_size + p_partkey % 2 end as predicted from part)
 select case when coalesce(e, nullif(q, '')) is null then 'no problem' when len(labels) = 0 then 'no steps' end as reason, count(*) as n, coalesce(sum(list_position(list_transform(labels, lambda x: coalesce(x, true)), false) - 1), 0)::bigint as errors, count(*) filter (where predicted = correct) as correct, count(*) filter (where predicted is null) as unknown from s group by 1""")
def expression_rows(spark, d):
    k = F.col("p_partkey")
    label = lambda i: F.when((i + k) % 6 != 0, (i + k) % 3 != 0)
    steps = F.when(F.col("p_size") % 4 == 0, F.expr("cast(array() as array<struct<content:string,label:boolean>>)")).otherwise(F.transform(F.sequence(F.lit(0), F.col("p_size").cast("int") % 4 - 1), lambda i: F.struct(i.cast("string").alias("content"), label(i).alias("label"))))
    s = table(spark, d, "part").select(k.alias("expression_id"), F.when(k % 5 != 0, F.col("p_name")).alias("original_expression"), F.when(k % 10 != 0, F.col("p_type")).otherwise("").alias("question"), F.lit(None).cast("string").alias("problem"), steps.alias("steps"),
                                           F.col("p_size").alias("correct_value"), F.when(k % 9 != 4, F.col("p_size") + k % 2).alias("predicted_value"))
    t = adapters.expression_steps(s, "arithmetic")
    return t.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("first_error_index"), F.lit(0)).alias("errors"), F.count_if("final_answer_correct").alias("correct"), F.count_if(F.col("final_answer_correct").isNull()).alias("unknown"))


_TRACE = f"""x as (select o_orderkey as k, {_SOURCES}[o_orderkey % 3 + 1] as d, {_SUBSETS}[o_orderkey % 7 + 1] as s, case o_orderstatus when 'F' then false when 'O' then o_orderkey % 2 = 0 end as correct, case when o_orderkey % 5 <> 0 then (o_custkey % 6)::int end as error,
  case when o_custkey % 4 = 0 then 'one' else 'zero' end as base, case when o_custkey % 8 = 3 then null else 'r' end as reference, case when o_custkey % 9 <> 1 then (o_orderkey % 4 + 1)::int end as steps from orders)"""


def _trace_rows(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    dataset, subset = _sources(k)
    return table(spark, d, "orders").select(
        k.alias("k"), dataset.alias("d"), subset.alias("s"), F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", k % 2 == 0).alias("correct"), F.when(k % 5 != 0, (c % 6).cast("int")).alias("error"),
        F.when(c % 4 == 0, "one").otherwise("zero").alias("base"), F.when(c % 8 != 3, "r").alias("reference"), F.when(c % 9 != 1, F.array_repeat(F.lit("step"), (k % 4 + 1).cast("int"))).alias("steps"),
    )


@query("cohort_exclusions", "FIL04", f"""with {_TRACE}, r as (select case when {_BUCKET} is null then 'outside_designated_sources' when correct is null or correct or error is null then 'not_failed_with_visible_error_annotation' when reference is null then 'missing_exact_terminal_reference'
 when steps is null then 'invalid_reasoning_steps' when error - (base = 'one')::int < 0 or error - (base = 'one')::int >= steps then 'first_error_outside_reasoning_steps' end as reason, k from x) select reason, count(*) as n, min(k) as first_id from r group by reason""")
def cohort_exclusions(spark, d):
    c = F.col
    r = _trace_rows(spark, d).withColumn("reason", adapters.cohort_reason(c("d"), c("s"), c("correct"), c("error"), c("base"), c("reference"), c("steps")))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_id"))


@query("corpus_exclusions", "FIL05", f"""with {_TRACE}, r as (select case when d <> 'Qwen/ProcessBench' then 'excluded_other_dataset' when s not in ('math', 'olympiadbench', 'omnimath') then 'excluded_unknown_domain' when correct then 'excluded_terminally_correct_trace'
 when base <> 'zero' or error is null then 'missing_or_ambiguous_first_error_annotation' when error >= steps then 'first_error_outside_reasoning_steps' when steps is null or k % 10 = 1 then 'source_step_checkpoint_mapping_is_not_exact' when k % 8 = 1 then 'no_existing_four_way_problem_split_assignment' end as reason, k from x)
 select reason, count(*) as n, min(k) as first_id from r group by reason""")
def corpus_exclusions(spark, d):
    c = F.col
    t = _trace_rows(spark, d).withColumns({"offsets": F.array_repeat(F.lit(0), F.coalesce(F.size("steps"), F.lit(0)) + F.when(c("k") % 10 == 1, 2).otherwise(1)), "split": F.when(c("k") % 8 != 1, "train")})
    offsets = F.when(c("steps").isNotNull(), c("offsets"))
    r = t.withColumn("reason", adapters.corpus_reason(c("d"), c("s"), c("correct"), c("base"), c("error"), F.coalesce("steps", F.expr("cast(array() as array<string>)")), F.when(c("steps").isNull(), F.array(F.lit(5))), offsets, c("split")))
    r = r.withColumn("reason", F.when(c("steps").isNull() & (c("reason") == "first_error_outside_reasoning_steps"), "source_step_checkpoint_mapping_is_not_exact").otherwise(c("reason")))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_id"))


@query("structural_exclusions", "FIL07", r"""with s as (select case when page_id % 6 = 0 then ' ' else page_id::varchar end as id, url as problem, case when page_id % 5 = 0 then [' ', ''] when page_id % 7 <> 0 then string_split(html, chr(10)) end as steps from pages)
 select case when trim(id) = '' then 'missing_problem_id' when trim(coalesce(problem, '')) = '' then 'missing_problem_text' when steps is null or len(list_filter(steps, lambda x: trim(x) <> '')) = 0 then 'missing_reasoning_steps' end as reason, case when regexp_matches(lower(coalesce(problem, '')), 'arithmetic|gsm8k|calculate|compute') then 'arithmetic' else 'word_problem' end as domain, count(*) as n from s group by 1, 2""")
def structural_exclusions(spark, d):
    k = F.col("page_id")
    s = table(spark, d, "pages").select(F.when(k % 6 == 0, " ").otherwise(k.cast("string")).alias("id"), F.col("url").alias("problem"), F.when(k % 5 == 0, F.array(F.lit(" "), F.lit(""))).when(k % 7 != 0, F.split("html", "\n", -1)).alias("steps"))
    return s.groupBy(adapters.structural_reason(F.col("id"), F.col("problem"), F.col("steps")).alias("reason"), adapters.keyword_domain(F.col("problem")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


_NORM = "sha256(replace(lower(trim(regexp_replace(replace(replace(t, chr(160), ' '), chr(13) || chr(10), chr(10)), '\\s+', ' ', 'g'))), 'ß', 'ss'))"
_LATEX = r"sha256(lower(regexp_replace(t, '\\(?:left|right|quad|qquad)|\\[,;!()]|\$|\s+', '', 'g')))"


@query("source_census", "FIL06", rf"""with p as (select 'b' || item_id as id, text as t from benchmark where item_id % 2 = 0), pp as (select id, {_NORM} as n, {_LATEX} as l from p where trim(t) <> ''),
 s as (select 'd' || (doc_id // 2 * 2 + (doc_id % 20 <> 1)::int) as id, doc_id as k, text || case when doc_id % 17 = 0 then ' \includegraphics{{x}}' else '' end as t, case when doc_id % 19 <> 0 then 'g' end as gold from documents
  union all select 'b' || item_id as id, 1000000000 + item_id as k, text as t, 'g' as gold from benchmark),
 h as (select *, {_NORM} as n, {_LATEX} as l from s),
 e as (select *, case when t is null or trim(t) = '' then 'corrupted_or_empty_problem' when gold is null then 'missing_deterministic_gold_answer' when regexp_matches(t, '(?i)\\includegraphics|\\begin\{{asy\}}|\[asy\]') then 'unavailable_image_or_diagram_dependency'
  when id in (select id from p) then 'protected_canonical_id_overlap' when n in (select n from pp) or l in (select l from pp) then 'protected_normalized_text_overlap' end as early from h),
 o as (select * from e where early is null), fi as (select id, min(k) as f from o group by id), fn as (select n, min(k) as f from o group by n), fl as (select l, min(k) as f from o group by l)
 select coalesce(early, case when k > least(fi.f, fn.f, fl.f) then 'duplicate_within_or_across_source_reservoir' end) as reason, count(*) as n, sum(k)::bigint as ids from e left join fi on e.id = fi.id left join fn on e.n = fn.n left join fl on e.l = fl.l group by 1""")
def source_census(spark, d):
    k, i = F.col("doc_id"), F.col("item_id")
    b = table(spark, d, "benchmark")
    protected = b.where(i % 2 == 0).select(F.concat(F.lit("b"), i.cast("string")).alias("source_id"), F.col("text").alias("problem_text"))
    ident = F.concat(F.lit("d"), (F.floor(k / 2) * 2 + (k % 20 != 1).cast("long")).cast("string"))
    own = table(spark, d, "documents").select(ident.alias("source_id"), k.alias("position"), F.concat("text", F.when(k % 17 == 0, " \\includegraphics{x}").otherwise("")).alias("problem_text"), F.when(k % 19 != 0, "g").alias("gold_answer"))
    own = own.unionByName(b.select(F.concat(F.lit("b"), i.cast("string")).alias("source_id"), (i + 1000000000).alias("position"), F.col("text").alias("problem_text"), F.lit("g").alias("gold_answer")))
    return adapters.source_census(own, protected).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("ids"))


@query("tagged_answers", "STR09", """select n_nationkey, '__stepweave_json__:' || to_json(n_name) as name, '__stepweave_json__:[' || n_regionkey || ',' || n_nationkey || ']' as keys, n_name as decoded from nation""")
def tagged_answers(spark, d):
    n = table(spark, d, "nation")
    keys = text.encode_answer(F.array(F.col("n_regionkey").cast("int"), F.col("n_nationkey").cast("int")))
    e = n.select("n_nationkey", "n_name", text.encode_answer(F.col("n_name")).alias("name"), keys.alias("keys"))
    return e.select("n_nationkey", "name", "keys", F.from_json(F.concat(F.lit('{"v":'), text.decode_answer(F.col("name")), F.lit("}")), "v string")["v"].alias("decoded"))
