"""Source rows as trace records, or with the first reason why they are none: nothing is dropped without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, text
from ..sources import sinks

#: Subsets of the labelled benchmark that the validity corpus takes, and what shows that a problem needs a picture.
DOMAINS = {"math": "processbench_math", "olympiadbench": "processbench_olympiadbench", "omnimath": "processbench_omnimath"}
IMAGES = (r"\\includegraphics", r"\\begin\{asy\}", r"\[asy\]")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds; null if none does, and a null condition does not."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules], F.lit(None).cast("string"))


def blank(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit(""))) == ""


def error_outside(error: Column, steps: Column) -> Column:
    """Whether a zero-based first error is not one of the steps."""
    return (error < 0) | (error >= F.size(steps))


def labelled_steps(rows: DataFrame, subset: str) -> DataFrame:
    """Rows (id, problem, steps, label, final_answer, final_answer_correct, generator, reference_answer) as traces with a ``reason``.

    A label below 0 means that no step is wrong.  Where the final answer is empty, it is parsed from the steps.
    """
    needed = ("final_answer_correct", "id", "label", "problem", "steps")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]))
    error = F.when(F.col("label") >= 0, F.col("label").cast("int"))
    parsed = F.coalesce(answers.answer_region(F.array_join("steps", "\n\n"))["parsed_answer"], F.lit(""))
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))).otherwise(
        first_reason([("empty id or problem", (F.col("id").cast("string") == "") | (F.col("problem") == "")), ("first error outside the steps", error_outside(error, F.col("steps")))])
    )
    return rows.select(
        F.col("id").cast("string").alias("problem_id"), F.lit(subset).alias("source_subset"), F.col("generator").alias("source_generator"), F.col("problem").alias("problem_text"), F.col("steps").alias("reasoning_steps"),
        F.when(blank(F.col("final_answer")), parsed).otherwise(F.col("final_answer").cast("string")).alias("final_answer_text"), F.col("reference_answer"), error.alias("first_error_index"),
        F.when(error.isNotNull(), F.lit("zero")).alias("index_base"), F.col("final_answer_correct"), reason.alias("reason"),
    )


def expression_steps(rows: DataFrame, subset: str) -> DataFrame:
    """Rows (expression_id, original_expression, question, problem, steps of (content, label), correct_value, predicted_value) as traces with a ``reason``.

    The first step labelled false is the first error; the answer is right if the predicted value equals the correct one, and
    unknown if either is null.
    """
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    problem = F.coalesce(filled("original_expression"), filled("question"), filled("problem"))
    at = F.array_position(F.transform("steps", lambda x: F.coalesce(x["label"], F.lit(True))), False)
    error = F.when(at > 0, (at - 1).cast("int"))
    return rows.select(
        F.concat(F.lit(f"{subset}:"), F.col("expression_id").cast("string")).alias("problem_id"), F.lit(subset).alias("source_subset"), problem.alias("problem_text"), F.transform("steps", lambda x: x["content"]).alias("reasoning_steps"),
        F.coalesce(F.col("predicted_value").cast("string"), F.lit("")).alias("final_answer_text"), F.col("correct_value").cast("string").alias("reference_answer"), error.alias("first_error_index"),
        F.when(error.isNotNull(), F.lit("zero")).alias("index_base"), (F.col("predicted_value") == F.col("correct_value")).alias("final_answer_correct"),
        first_reason([("no problem", problem.isNull()), ("no steps", F.coalesce(F.size("steps"), F.lit(0)) <= 0)]).alias("reason"),
    )


def cohort_reason(dataset: Column, subset: Column, correct: Column, error: Column, base: Column, reference: Column, steps: Column) -> Column:
    """Why a row is not in the cohort of failed traces with a visible error."""
    zero = error - (base == "one").cast("int")
    return first_reason([
        ("outside_designated_sources", answers.source_bucket(dataset, subset).isNull()),
        ("not_failed_with_visible_error_annotation", correct.isNull() | correct | error.isNull()),
        ("missing_exact_terminal_reference", F.coalesce(reference, F.lit("")) == ""),
        ("invalid_reasoning_steps", steps.isNull()),
        ("first_error_outside_reasoning_steps", error_outside(zero, steps)),
    ])


def corpus_reason(dataset: Column, subset: Column, correct: Column, base: Column, error: Column, steps: Column, indices: Column, offsets: Column, split: Column) -> Column:
    """Why a trace is not in the validity corpus; checkpoints must be the prompt and every step, each with an offset."""
    n = F.size(steps)
    own = F.coalesce(indices, F.sequence(F.lit(0), n))
    return first_reason([
        ("excluded_other_dataset", dataset.isNull() | (dataset != "Qwen/ProcessBench")),
        ("excluded_unknown_domain", subset.isNull() | ~subset.isin(*DOMAINS)),
        ("excluded_terminally_correct_trace", correct),
        ("missing_or_ambiguous_first_error_annotation", base.isNull() | (base != "zero") | error.isNull()),
        ("first_error_outside_reasoning_steps", error_outside(error, steps)),
        ("source_step_checkpoint_mapping_is_not_exact", (own != F.sequence(F.lit(0), n)) | (F.coalesce(F.size(offsets), F.lit(0)) != F.size(own))),
        ("no_existing_four_way_problem_split_assignment", split.isNull()),
    ])


def structural_reason(id_: Column, problem: Column, steps: Column) -> Column:
    return first_reason([("missing_problem_id", blank(id_)), ("missing_problem_text", blank(problem)), ("missing_reasoning_steps", ~F.coalesce(F.exists(steps, lambda x: ~blank(x)), F.lit(False)))])


def keyword_domain(*fields: Column) -> Column:
    return F.when(F.lower(F.concat_ws(" ", *fields)).rlike("arithmetic|gsm8k|calculate|compute"), "arithmetic").otherwise("word_problem")


def source_census(rows: DataFrame, protected: DataFrame, *, order: str = "position") -> DataFrame:
    """(source_id, ``order``, reason) of rows (source_id, problem_text, gold_answer, ``order``): the first reason that keeps a row out of a reservoir.

    ``protected`` has (source_id, problem_text) of what other roles use; ``order`` is the rows' own sequence, without repeats.  Of rows that none of the
    first five rules keeps out, the first of an id, of a normalised text and of a text without layout and white space stays, and the others are
    duplicates.  Texts are read once; what is joined are their hashes.
    """
    problem = F.col("problem_text")
    keys = rows.select(
        "source_id", order, text.exact_hash(problem).alias("_n"), text.latex_hash(problem).alias("_l"), blank(problem).alias("_empty"),
        (F.coalesce("gold_answer", F.lit("")) == "").alias("_bare"), problem.rlike("(?i)" + "|".join(IMAGES)).alias("_image"),
    )
    folder = sinks.scratch(rows.sparkSession)
    keys.write.parquet(folder)
    own = rows.sparkSession.read.parquet(folder)
    ids = protected.where("source_id is not null").select("source_id").distinct().withColumn("_pi", F.lit(True))
    some = protected.where(~blank(problem)).select(text.exact_hash(problem).alias("_n"), text.latex_hash(problem).alias("_l"))
    own = own.join(ids, "source_id", "left").join(some.select("_n").distinct().withColumn("_pn", F.lit(True)), "_n", "left").join(some.select("_l").distinct().withColumn("_pl", F.lit(True)), "_l", "left")
    early = first_reason([
        ("corrupted_or_empty_problem", F.col("_empty")),
        ("missing_deterministic_gold_answer", F.col("_bare")),
        ("unavailable_image_or_diagram_dependency", F.col("_image")),
        ("protected_canonical_id_overlap", F.col("_pi")),
        ("protected_normalized_text_overlap", F.coalesce("_pn", "_pl")),
    ])
    own = own.withColumn("_early", early)
    open_ = own.where("_early is null")
    for key in ("source_id", "_n", "_l"):  # texts equal in the finer form are equal in the coarser one
        own = own.join(open_.groupBy(key).agg(F.min(order).alias(f"_f{key}")), key, "left")
    late = F.col(order) > F.least(*[F.col(f"_f{k}") for k in ("source_id", "_n", "_l")])
    return own.select("source_id", order, F.coalesce("_early", F.when(late, "duplicate_within_or_across_source_reservoir")).alias("reason"))
