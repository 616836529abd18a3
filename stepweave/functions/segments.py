"""Sequential text functions: balanced boxes, depth, segments and alignment, as Arrow functions on whole columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

BOX = re.compile(r"\\boxed\s*\{")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def boxed_regions(text: str | None) -> list[dict]:
    """Every closed ``\\boxed{...}`` with balanced braces, escapes minded (white space before the brace is allowed): start, end, content."""
    out = []
    for opened in BOX.finditer(text or ""):
        depth, end, escaped = 1, len(text), False
        for i in range(opened.end(), len(text)):
            c = text[i]
            if escaped or c == "\\":
                escaped = not escaped
                continue
            depth += (c == "{") - (c == "}")
            if not depth:
                end = i + 1
                break
        if not depth:
            out.append({"start": opened.start(), "end": end, "content": text[opened.end() : end - 1]})
    return out


def latex_depths(text: str | None) -> list[int]:
    """For each character, how many braces are open before it, plus one inside dollar signs."""
    out, braces, inside = [], 0, 0
    for i, c in enumerate(text or ""):
        out.append(braces + inside)
        if i and text[i - 1] == "\\":
            continue
        if c == "{":
            braces += 1
        elif c == "}":
            braces = max(0, braces - 1)
        elif c == "$":
            inside ^= 1
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Places of the runs that are not white space: the stand-in tokenizer of the segmenters."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def paragraphs(text: str | None) -> list[dict]:
    """Runs between blank lines: index, start, end."""
    out, at = [], 0
    for m in [*re.finditer(r"\n\s*\n+", text or ""), None]:
        end = m.start() if m else len(text or "")
        if (text or "")[at:end].strip():
            out.append({"index": len(out), "start": at, "end": end})
        at = m.end() if m else end
    return out


def fixed_segments(text: str | None, size: int) -> list[dict]:
    """Segments of ``size`` tokens each; the last may be shorter."""
    t = tokens(text or "")
    return [{"index": k, "start": t[i][0], "end": t[min(i + size, len(t)) - 1][1]} for k, i in enumerate(range(0, len(t), size))]


def hybrid_segments(text: str | None, least: int = 24, most: int = 128) -> list[dict]:
    """Segments that end at sentences or lines outside formulas, of ``least`` to ``most`` tokens; a short tail joins the one before."""
    text = text or ""
    t, depth = tokens(text), latex_depths(text)
    if not t:
        return []
    ends = {m.start() for m in SENTENCE.finditer(text) if m.start() < len(depth) and not depth[m.start()]} | {len(text)}
    legal = [i for i, (_, e) in enumerate(t) if e in ends or e == len(text.rstrip())]
    out, first = [], 0
    while first < len(t):
        fit = [i for i in legal if first + least - 1 <= i <= first + most - 1]
        last = fit[-1] if fit else min(first + most, len(t)) - 1
        out.append([first, last])
        first = last + 1
    if len(out) > 1 and out[-1][1] - out[-1][0] + 1 < least:
        out[-2][1] = out[-1][1]
        out.pop()
    return [{"index": k, "start": t[a][0], "end": t[b][1]} for k, (a, b) in enumerate(out)]


def legacy_list(value: str | None) -> list[str] | None:
    """Items of a printed list of quoted strings; neighbouring literals are separate items."""
    if value is None:
        return None
    found = re.findall(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"", value)
    return [re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), a or b) for a, b in found]


def snap(offsets: list[tuple[int, int]], place: int) -> dict:
    """The token that ends at or before a place and the one that begins at or after it, and how far the place is from a border."""
    before = max((i for i, (_, e) in enumerate(offsets) if e <= place), default=-1)
    after = min((i for i, (s, _) in enumerate(offsets) if s >= place), default=len(offsets))
    borders = [0, *[e for _, e in offsets], *[s for s, _ in offsets]]
    return {"before": before, "after": after, "exact": place in borders, "displacement": min(abs(place - b) for b in borders)}


_SPANS = "array<struct<index:int,start:int,end:int>>"


def boxed_udf():
    @F.pandas_udf("array<struct<start:int,end:int,content:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(boxed_regions)

    return run


def paragraphs_udf():
    @F.pandas_udf(_SPANS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(paragraphs)

    return run


def hybrid_udf():
    @F.pandas_udf(_SPANS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(hybrid_segments)

    return run


def fixed_udf(size: int):
    @F.pandas_udf(_SPANS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fixed_segments(x, size))

    return run


def legacy_udf():
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(legacy_list)

    return run
