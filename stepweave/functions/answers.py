"""Final answers of completions: one ordered list of rules, with the places of what each rule finds.

A rule takes a text and gives a ``Found``: the region that makes the answer and the answer inside it, as places in the text.  The
rules run as an Arrow-batched function; everything after them (acceptance, classification, prompts) is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .segments import boxed_regions, tokens

# The patterns that decide what counts as an answer, in the order of their rules.
MARKER_LINE = re.compile(r"(?im)^\s*(?:#{1,6}\s*)?(?:final\s+answer|answer)\s*:?[ \t]*(.*)$")
MATH = re.compile(r"(?s)\$\$([^$]+)\$\$|\\\[([^\]]+)\\\]|\$([^$]+)\$|\\\((.+?)\\\)")
EQUALS = re.compile(r"(?<![<>])=(?!=)")
SCALAR = re.compile(r"(?i)(?:[$£€]\s*)?[-+]?\s*(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:\s*/\s*[-+]?\s*(?:\d[\d,]*(?:\.\d+)?|\.\d+))?%?")
SYMBOL = re.compile(r"(?i)\b(?:undefined|true|false|yes|no|[A-E])\b[.!]?\s*$")
WRAPPED = re.compile(r"(?s)(?:\$\$?|\\\[|\\\()?(.+?)(?:\$\$?|\\\]|\\\))?\.?")
ISOLATED = re.compile(
    r"(?i)(?:[-+$£€]?\s*[\d,./%]+|[-+]?\\frac\s*\{[^{}]+\}\s*\{[^{}]+\}|[-+]?\\sqrt\s*\{[^{}]+\}|[-+]?\s*[a-z]\s*=\s*[^\n]+"
    r"|\([^\n]{1,120}\)|\[[^\n]{1,120}\]|True|False|yes|no|[A-E])"
)
ASSERTIVE = re.compile(
    r"(?i)\b(?:therefore|thus|hence|so|consequently|we\s+(?:can\s+now\s+)?conclude|the\s+(?:final\s+)?(?:answer|result|solution|value|expression|remainder)"
    r"|as\s+the\s+answer\s+must\s+be|this\s+implies|there\s+are)\b"
)
LONGEST_ISOLATED, LONGEST_ASSERTION = 160, 700
#: Fixed values of the failure classifier.
EVIDENCE_MARKER = r"(?im)^\s*(?:final\s+answer|answer)\s*:\s*(.*)$"
EVIDENCE_PHRASE = r"(?is)(?:therefore|thus|hence|so|consequently)?\s*,?\s*(?:the\s+)?(?:final\s+)?(?:answer|result|value)\s+is\s*:?[ \t]*([^\n]+)\s*$"
EVIDENCE_LINE = r"(?i)^(?:[-+$£€]?\s*[\d,]+(?:\.\d+)?(?:\s*/\s*[-+]?\d+(?:\.\d+)?)?%?|\\?[a-z]+(?:\s*\{[^\n]+\})?|\$[^\n$]+\$|\([^\n]{1,120}\)|true|false|yes|no|[A-E])$"
LONGEST_EVIDENCE = 180
#: Method, confidence and priority of the rules.
RULES = {"last_boxed": ("high", 1), "final_answer_marker": ("high", 2), "isolated_answer_line": ("medium", 4), "dataset_specific": ("high", 5), "final_assertion": ("medium", 6)}
#: Methods that count although the completion was cut off at its length.
DELIMITED = ("last_boxed", "final_answer_marker", "dataset_specific")
#: The instructions put before a problem.
PROMPTS = {
    "P0": "Solve the problem step by step. Put your final answer in \\boxed{}.",
    "P1": "Solve the problem step by step. Put each major reasoning step in a separate paragraph. Put your final answer in \\boxed{}.",
    "P2": "Solve the problem in numbered reasoning steps. Put your final answer in \\boxed{}.",
}


class Found(NamedTuple):
    start: int
    end: int
    low: int  # the answer itself
    high: int


def _trimmed(text: str, low: int, high: int) -> tuple[int, int]:
    """The places without the white space at both ends."""
    own = text[low:high]
    return low + len(own) - len(own.lstrip()), low + len(own.rstrip())


def value_place(text: str, low: int, high: int) -> tuple[int, int] | None:
    """Where the answer stands in a stretch of text: the last formula (right of its last equals sign), the last number, or a closing symbol."""
    low, high = _trimmed(text, low, high)
    own = text[low:high]
    *_, formula = (None, *MATH.finditer(own))
    if formula:
        a, b = _trimmed(own, *formula.span(formula.lastindex))
        *_, sign = (None, *EQUALS.finditer(own[a:b]))
        if sign and a + sign.end() < b:
            a, b = _trimmed(own, a + sign.end(), b)
        return low + a, low + b
    *_, number = (None, *SCALAR.finditer(own))
    if number:
        return _trimmed(text, low + number.start(), low + number.end())
    symbol = SYMBOL.search(own)
    return (low + symbol.start(), low + symbol.start() + len(symbol[0].rstrip(".! "))) if symbol else None


def _lines(text: str) -> list[tuple[int, int]]:
    """Places of the lines that are not empty, up to the last character that is not white space."""
    return [m.span() for m in re.finditer(r"[^\n]+", text.rstrip())]


def in_box(text: str) -> Found | None:
    boxes = boxed_regions(text)
    if not boxes:
        return None
    start, end, content = boxes[-1]["start"], boxes[-1]["end"], boxes[-1]["content"].strip()
    low = text.find(content, start, end) if content else end - 1
    return Found(start, end, low, low + len(content))


def after_marker(text: str) -> Found | None:
    for m in reversed(list(MARKER_LINE.finditer(text))):
        span = m.span(1)
        if not m[1].strip():  # the value may stand on the next line
            below = re.search(r"(?m)^\s*(\S[^\n]*)$", text[m.end() :])
            if below:
                span = m.end() + below.start(1), m.end() + below.end(1)
        place = value_place(text, *span)
        if place:
            return Found(m.start(), max(m.end(), place[1]), *place)
    return None


def on_own_line(text: str) -> Found | None:
    for a, b in reversed(_lines(text)):
        bare = text[a:b].strip()
        if not bare or len(bare) > LONGEST_ISOLATED:
            continue
        wrapped = WRAPPED.fullmatch(bare)
        inner = wrapped[1].strip() if wrapped else bare
        if ISOLATED.fullmatch(inner):
            low = a + text[a:b].find(inner)
            return Found(a, b, low, low + len(inner))
    return None


def in_conclusion(text: str) -> Found | None:
    lines = _lines(text)
    if not lines or lines[-1][1] - lines[-1][0] > LONGEST_ASSERTION:
        return None
    a, b = lines[-1]
    claim = ASSERTIVE.search(text[a:b])
    place = claim and value_place(text, a + claim.start(), b)
    return Found(a, b, *place) if place else None


def parse(text: str | None, dataset: Callable[[str], tuple[object, tuple[int, int]] | None] | None = None) -> dict:
    """The answer that the first rule in order finds, with where it stands; ``dataset`` is a source's own rule, before the weakest one."""
    text = text or ""

    def own(t: str) -> Found | None:
        nonlocal value
        hit = dataset(t) if dataset else None
        if hit is None:
            return None
        value = str(hit[0])
        return Found(*hit[1], *hit[1])

    value = None
    for method, rule in zip(RULES, (in_box, after_marker, on_own_line, own, in_conclusion), strict=True):
        found = rule(text)
        if found:
            inside = text[found.low : found.high]
            confidence, priority = RULES[method]
            return {
                "success": True, "method": method, "text": inside, "char_start": found.start, "char_end": found.end, "parsed_answer": inside if value is None else value, "failure_reason": None,
                "confidence": confidence, "rule_priority": priority, "content_char_start": found.low, "content_char_end": found.high, "token_start": None, "token_end": None,
            }
    return dict.fromkeys(FIELDS) | {"success": False, "method": "none", "failure_reason": "no deterministic answer region", "confidence": "none"}


FIELDS = ("success", "method", "text", "char_start", "char_end", "parsed_answer", "failure_reason", "confidence", "rule_priority", "content_char_start", "content_char_end", "token_start", "token_end")
REGION = (
    "success boolean, method string, text string, char_start int, char_end int, parsed_answer string, failure_reason string, confidence string, rule_priority int, "
    "content_char_start int, content_char_end int, token_start int, token_end int"
)


def answer_region(text: Column, dataset: Callable | None = None) -> Column:
    """A struct of 13 fields; a null text counts as empty."""

    @F.pandas_udf(REGION)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            out = pd.DataFrame([parse(x, dataset) for x in s], columns=FIELDS)
            for c in ("char_start", "char_end", "rule_priority", "content_char_start", "content_char_end", "token_start", "token_end"):
                out[c] = out[c].astype("Int32")
            yield out

    return run(text)


def acceptable(region: Column, finish: Column) -> Column:
    """Whether a parsed answer counts: a completion that was cut off needs a box, a marker or its source's own rule."""
    return region["success"] & (~F.coalesce(finish == "length", F.lit(False)) | region["method"].isin(*DELIMITED))


def closed_boxes(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: len(boxed_regions(x))).astype("int32"), "int")(text)


def unclosed_box(text: Column) -> Column:
    """Whether more boxes are opened than closed."""
    return F.regexp_count(text, F.lit(r"\\boxed\s*\{")) > closed_boxes(text)


def reasoning_split(text: Column) -> Column:
    """(reasoning_end, token_end): the reasoning before the answer, to the last whole token that ends before it; null without an answer."""

    @F.pandas_udf("reasoning_end int, token_end int")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            start = parse(x)["char_start"]
            before = [e for _, e in tokens(x or "") if e <= start] if start is not None else None
            out.append((None, None) if before is None else (before[-1] if before else 0, len(before)))
        return pd.DataFrame(out, columns=["reasoning_end", "token_end"]).astype("Int32")

    return run(text)


def step_audit(steps: Column) -> Column:
    """For each step of a completion (steps joined by blank lines after a newline): where it ends, the token border at or after that, and whether
    the prefix up to there holds the whole step and nothing of the next one."""

    @F.pandas_udf("array<struct<step_index:int,requested:int,token_offset:int,resolved:int,exact:boolean,displacement:int,sound:boolean>>")
    def run(s: pd.Series) -> pd.Series:
        def audit(own) -> list[dict]:
            text, ends, starts, at = "\n", [], [], 1
            for x in own:
                starts.append(at)
                ends.append(at + len(x))
                at += len(x) + 2
            text += "\n\n".join(own)
            places, out = tokens(text), []
            i = 0
            for k, end in enumerate(ends):
                while i < len(places) and places[i][0] < end:
                    i += 1
                resolved = places[i - 1][1] if i else 0
                after = starts[k + 1] if k + 1 < len(starts) else len(text)
                out.append({"step_index": k, "requested": end, "token_offset": i, "resolved": resolved, "exact": resolved == end, "displacement": resolved - end, "sound": end <= resolved <= after or not own[k].strip()})
            return out

        return s.map(lambda own: [] if own is None else audit([x or "" for x in own]))

    return run(steps)


def answer_only(step: Column, answer: Column) -> Column:
    """Whether a step is nothing but the final answer: bare, in a box, or after a marker."""
    bare = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"\.+$", ""), r"\s+", ""))
    own, value = F.trim(F.coalesce(step, F.lit(""))), F.trim(F.coalesce(answer, F.lit("")))
    unmarked = F.regexp_replace(own, r"(?i)^(?:final\s+answer|answer|the\s+final\s+answer\s+is)\s*[:=]?\s*", "")
    wanted = [bare(value), bare(F.concat(F.lit("\\boxed{"), value, F.lit("}")))]
    return (own != "") & (value != "") & (bare(own).isin(*wanted) | bare(unmarked).isin(*wanted))


def failure_category(text: Column, region: Column, finish: Column) -> Column:
    """(category, bucket) of a completion whose answer was looked for: the first of ten findings that holds."""
    last = F.try_element_at(F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(-1))
    marked = F.trim(F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(EVIDENCE_MARKER), F.lit(1)), F.lit(-1)), F.lit("")))
    phrase = F.regexp_extract(F.rtrim(text), EVIDENCE_PHRASE, 1)
    open_ = unclosed_box(text)
    one = lambda category, bucket: F.struct(F.lit(category).alias("category"), F.lit(bucket).alias("bucket"))
    whole = "A_complete_answer_recoverable"
    return (
        F.when(region["success"] & (region["method"] == "last_boxed"), one("complete boxed answer parsed correctly", "not_an_original_parser_failure"))
        .when(closed_boxes(text) > 0, one("complete boxed answer missed", whole))
        .when(marked != "", one("answer written after Final answer:", whole))
        .when(text.rlike(r"(?im)^\s*answer\s*:"), one("answer written after Answer:", whole))
        .when(F.coalesce((F.length(last) <= LONGEST_EVIDENCE) & last.rlike(EVIDENCE_LINE), F.lit(False)), one("answer given as final isolated line", whole))
        .when(F.trim(phrase) != "", one("valid answer in another common deterministic format", whole))
        .when(open_, one("malformed or unclosed box", "D_other_malformed"))
        .when(finish == "length", one("output-length limit reached", "B_genuinely_ended_before_complete_answer"))
        .when(finish == "eos", one("response ended at EOS without final answer", "C_complete_without_identifiable_answer"))
        .otherwise(one("no final answer despite sufficient generation budget", "C_complete_without_identifiable_answer"))
    )


def prompt(problem: Column, condition: Column) -> Column:
    """The instruction of a condition, a blank line and the trimmed problem; an unknown condition is an error."""
    known = F.coalesce(*[F.when(condition == k, F.lit(v)) for k, v in PROMPTS.items()], F.raise_error(F.concat(F.lit("unknown prompt condition: "), condition)))
    return F.concat(known, F.lit("\n\n"), F.regexp_replace(problem, r"^\s+|\s+$", ""))


def reference_answer(source: Column, answer: Column, solution: Column, final_answer: Column) -> Column:
    """The reference answer of a source's row: after ``####`` without commas, parsed from the solution, or the row's own field."""
    given = F.coalesce(answer, final_answer)
    hashed = F.replace(F.trim(F.regexp_extract(F.coalesce(answer, F.lit("")), r"####\s*([^\n]+)\s*$", 1)), F.lit(","), F.lit(""))
    return (
        F.when(source == "gsm8k", F.when(hashed != "", hashed))
        .when(source == "math", answer_region(solution)["parsed_answer"])
        .when(source.isin("olympiadbench", "omnimath"), given)
        .otherwise(F.raise_error(F.concat(F.lit("unknown source: "), source)))
    )


def source_bucket(dataset: Column, subset: Column) -> Column:
    """The designated source of a row, by its dataset and subset; null outside of them."""
    d, s = F.lower(F.coalesce(dataset, F.lit(""))), F.replace(F.lower(F.coalesce(subset, F.lit(""))), F.lit("-"), F.lit("_"))
    bench = d.contains("processbench")
    return (
        F.when(d.contains("facebook/crv") & (s.contains("arithmetic") | s.startswith("arith.")), "crv_arithmetic")
        .when(bench & s.contains("olympiad"), "processbench_olympiadbench")
        .when(bench & (s.contains("omnimath") | s.contains("omni_math")), "processbench_omnimath")
        .when(bench & ((s == "math") | s.endswith("/math")), "processbench_math")
    )
