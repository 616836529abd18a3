"""Secret scans with multipart credential linking, in DataFrame operations alone.

Each text is read for access identifiers, secrets and endpoints.  What is clear by its
form alone is a base span.  Weaker parts (a short assigned value, a short or named identifier, a mixed
token, an address) are only reported where a complementary part lies within ``SCOPE`` characters:
an interval join on the scopes of a document.

Places of matches come from the lengths of the pieces between them, so that no
code outside the engine's own functions reads a text.  A text is only taken apart
for a pattern that a first look finds in it; what leaves the scan is spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NARROW, cut

#: Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weaker parts.
SHORT_ACCESS = r"AKIA[A-Z0-9]+"
NAMED_ACCESS = r"""(?i:access_key_id|access_id|client_id|account_id|user_id|username)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,})"""
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""(?:https?|s3|ftp|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\x20\x09-\x0D"'<>]+"""
#: Kinds in the order in which spans of one place are listed.
KINDS = ("assign", "access", "hex", "weak_assign", "weak_access", "weak_token", "endpoint")
SCOPE = 300
FOLD = 64
_LEAST = {"assign": 12, "weak_assign": 6}
_NONE = "array<struct<s:int,k:int,e:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: int, keep, group: int = 0, look: Column | None = None) -> Column:
    """(start, kind, end) of the leftmost non-overlapping matches that ``keep``, a function of the group's text, accepts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), own, lambda x, o: F.struct(x["g"].alias("g"), x["m"].alias("m"), o.alias("o")))

    def step(acc: Column, x: Column) -> Column:
        low, high = acc["at"] + x["g"], acc["at"] + x["g"] + F.coalesce(x["m"], F.lit(0))
        one = F.array(F.struct(low.alias("s"), F.lit(kind).alias("k"), high.alias("e")))
        return F.struct(high.alias("at"), F.when(x["m"].isNotNull() & keep(x["o"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # Places are running sums. They are taken within blocks of FOLD matches and over the blocks, so that appending to an array stays cheap in
    # a text with very many matches.
    def folded(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / FOLD).cast("int")), lambda b: F.slice(z, b * FOLD + 1, F.lit(FOLD)))
        width = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["g"] + F.coalesce(x["m"], F.lit(0)))
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        starts = lambda w: F.aggregate(w, begin, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        inner = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.expr(f"cast(array() as {_NONE})").alias("out")), step, lambda acc: acc["out"])
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(F.transform(bs, width)), inner)))

    spans = _let(zipped, folded)
    seen = text.rlike(pattern) if look is None else look & text.rlike(pattern)
    return F.when(seen, spans).otherwise(F.expr(f"cast(array() as {_NONE})"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def parts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (uid, doc_id, base, weak): the spans of each text that stand alone and those that need a complement."""
    t = F.col("_t")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    size = lambda low, high=None: lambda o: (F.length(o) >= low) & (F.lit(True) if high is None else F.length(o) < high)
    always = lambda o: F.lit(True)
    mixed = lambda o: o.rlike("[a-z]") & o.rlike("[A-Z]") & o.rlike("[0-9]") & ~o.startswith("AKIA")
    digits = t.rlike("[0-9]")
    base = F.concat(_spans(t, ASSIGN, 0, size(_LEAST["assign"]), 2), _spans(t, ACCESS, 1, always, look=t.contains("AKIA")), _spans(t, HEX, 2, always))
    weak = F.concat(
        _spans(t, ASSIGN, 3, size(_LEAST["weak_assign"], _LEAST["assign"]), 2),
        _spans(t, SHORT_ACCESS, 4, size(12, 18), look=t.contains("AKIA")),
        _spans(t, NAMED_ACCESS, 4, always, 1, look=t.contains("=") | t.contains(":")),
        _spans(t, TOKEN, 5, mixed, look=digits),
        _spans(t, ENDPOINT, 6, always, look=t.contains("://")),
    )
    return rows.select("doc_id", base.alias("base"), weak.alias("weak"))


def linked(found: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """(uid, spans): the weak spans of each row of (uid, base, weak) with a complementary part within ``scope`` characters.

    Access identifiers complement secrets, endpoints complement secrets, and secrets both.  A weak span inside a base span is left out.  The join is on
    the stretch of ``scope`` characters in which a part begins and its two neighbours; spans
    within a stretch are bounded by its length, so pairs grow with the text and not with its square.
    """
    role = F.when(F.col("k").isin(1, 4), 1).when(F.col("k") == 6, 2).otherwise(0)  # 0 secrets, 1 access identifiers, 2 endpoints
    some = found.where(F.size("weak") > 0).where(F.size("weak") + F.size("base") > 1)
    stretch = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    known = some.select("uid", F.explode("base").alias("p")).select("uid", "p.s", "p.k", "p.e")
    cover = known.select(F.col("uid").alias("u"), F.col("s").alias("os"), F.col("e").alias("oe"), stretch(F.col("s"), F.col("e")).alias("ob"))
    open_ = some.select("uid", F.explode("weak").alias("p")).select("uid", "p.s", "p.k", "p.e").withColumn("b", F.floor(F.col("s") / scope))
    inside = (F.col("uid") == F.col("u")) & (F.col("b") == F.col("ob")) & (F.col("os") <= F.col("s")) & (F.col("e") <= F.col("oe"))
    every = cut(known.unionByName(open_.join(cover, inside, "left_anti").drop("b")).withColumn("r", role), NARROW)
    ends = every.select("uid", "s", "e", "r", F.explode(F.sequence(F.floor(F.col("s") / scope), F.floor(F.col("e") / scope))).alias("b"))
    weak = every.where("k >= 3").select("uid", "s", "k", "e", "r", F.explode(F.sequence(F.floor((F.col("s") - scope) / scope), F.floor((F.col("e") + scope) / scope))).alias("b"))
    other = ends.select(F.col("uid").alias("u"), F.col("b").alias("ob"), F.col("s").alias("os"), F.col("e").alias("oe"), F.col("r").alias("orole"))
    near = (F.col("uid") == F.col("u")) & (F.col("b") == F.col("ob")) & (F.col("os") <= F.col("e") + scope) & (F.col("s") <= F.col("oe") + scope)
    fits = (F.col("r") != F.col("orole")) & ((F.col("r") == 0) | (F.col("orole") == 0))
    hits = weak.join(other, near & fits, "left_semi").select("uid", "s", "k", "e").distinct()
    return hits.groupBy("uid").agg(F.collect_list(F.struct("s", "k", "e")).alias("spans"))


def scan(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and linked spans as arrays of (s, k, e), in code points, ends exclusive.

    ``k`` is the place in ``KINDS``.  Base spans are always reported, weak ones only with a complement in scope.
    A weak span that lies inside a base span is left out.  A null text counts as empty.  Rows with
    the same doc_id are separate texts.  Other columns are ignored, and an empty table gives an empty result.
    """
    found = parts(docs, text=text, doc_id=doc_id)
    found = cut(found.withColumn("uid", F.monotonically_increasing_id()), NARROW)
    out = found.join(linked(found, scope=scope), "uid", "left")
    return out.select("doc_id", "base", F.coalesce("spans", F.expr(f"cast(array() as {_NONE})")).alias("linked"))
