"""Operator 3 [native]: secrets by patterns and by sliding-window Shannon entropy.

Three base patterns (assignments, access keys, long hex runs) give the spans
that are always reported.  In addition every run of key characters is a
candidate: a window of ``WINDOW`` characters slides over it, the counts of
its characters are kept up to date as one character enters and one leaves,
and the entropy follows from the sum of c*log2(c), of which only two terms
change per step.  A candidate whose best windows reach the threshold of its
character class (hex digits or any key characters) adds the span from the
first such window to the last, unless the allow list knows it or base spans
already cover all of it.

Everything is DataFrame expressions.  Positions are code points: the text
is split by the pattern, and the lengths of pieces and matches are summed by
a scan that doubles its stride, so a text of n matches takes n log n steps.
No shuffle is needed.

Defined cases: a null text counts as empty; a text without secrets has
counts of 0, empty spans and the digest of the empty string; repeated rows
give repeated results; an empty table gives an empty result; columns other
than the key and the text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm.common import packed, table
from grantlens.llm.quality import let
from grantlens.session import ensure_parallelism

#: Kind, pattern, and the group and length that make a match count.
BASE = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),  # a run of hex digits is matched whole, so shorter ones need no look
)
ENTROPY = "entropy"
KINDS = [k for k, *_ in BASE] + [ENTROPY]
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character from which a window counts, by character class.
HEX_BITS, KEY_BITS = 3.0, 3.6
HEX_CLASS = "^(?:[0-9a-f]+|[0-9A-F]+)$"
#: Candidates that are never reported: without a digit or without a letter, identifiers
#: in the UUID form, placeholders, and words joined by path or name separators.  A
#: placeholder stands for its own part between separators: every other part has to be
#: of letters or digits alone.
PLACEHOLDER = "example|placeholder|changeme|dummy|x{6}|0123456789|abcdefgh"
ALLOWED = ("^[^0-9]+$", "^[^A-Za-z]+$", "^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
           f"(?i)^(?=.*(?:{PLACEHOLDER}))(?!.*(?<![a-z0-9])(?![a-z0-9]*(?:{PLACEHOLDER}))(?=[a-z]*[0-9])(?=[0-9]*[a-z]))",
           "^(?:[A-Za-z]+|[0-9]+)(?:[/_=+-]+(?:[A-Za-z]+|[0-9]+))*$")
MARK = "[SECRET]"


def running_sums(values: Column) -> Column:
    """Inclusive prefix sums: in round k every element adds the one 2**k places before it."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), values, lambda a, k: F.when(
        F.size(a) > F.call_function("shiftleft", F.lit(1), k),
        F.transform(a, lambda v, i: v + F.coalesce(F.get(a, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))
    ).otherwise(a))


def matches_of(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all leftmost non-overlapping matches."""
    none = F.expr("array()").cast("array<struct<start:int,end:int,match:string>>")

    def placed(both):
        ends = running_sums(F.transform(both["found"], lambda m, i: F.length(F.get(both["pieces"], i)) + F.length(m)))
        return let(ends, lambda e: F.transform(both["found"], lambda m, i: F.struct(
            (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("match"))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                    F.split(text, pattern, -1).alias("pieces"))
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) of the base patterns; kind is the place in ``KINDS``."""
    def of(kind, pattern, group, least):
        long_enough = (lambda x: F.length(F.regexp_extract(x["match"], pattern, group)) >= least) if group else \
            (lambda x: F.length(x["match"]) >= least)
        return F.transform(F.filter(matches_of(text, pattern), long_enough), lambda x: F.struct(
            x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.array_sort(F.concat(*(of(i, p, g, n) for i, (_, p, g, n) in enumerate(BASE))))


def hot_range(run: Column) -> Column:
    """(from, to) in a run: first and last window of enough entropy, or (-1, -1)."""
    zero = F.array_repeat(F.lit(0), len(ALPHABET))
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    bits = F.when(run.rlike(HEX_CLASS), F.lit(HEX_BITS)).otherwise(F.lit(KEY_BITS))

    def place(i):
        return F.instr(F.lit(ALPHABET), F.substring(run, i + 1, F.lit(1))) - 1

    def weight(c):  # c*log2(c)
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def step(a, i):
        def moved(x):
            entering, leaving = x["entering"], x["leaving"]
            changed = entering != leaving
            up, down = F.get(a["counts"], entering), F.coalesce(F.get(a["counts"], leaving), F.lit(0))
            total = a["total"] + F.when(changed, weight(up + 1) - weight(up) + weight(down - 1) - weight(down)).otherwise(F.lit(0.0))
            counts = F.transform(a["counts"], lambda c, k: c + (k == entering).cast("int") - (k == leaving).cast("int"))
            hit = (i >= WINDOW - 1) & (F.lit(WINDOW).cast("double") * (F.log2(F.lit(float(WINDOW))) - bits) >= total - 1e-9)
            return F.struct(
                counts.alias("counts"), total.alias("total"),
                F.when(hit & (a["first"] < 0), i - (WINDOW - 1)).otherwise(a["first"]).alias("first"),
                F.when(hit, i + 1).otherwise(a["last"]).alias("last"))
        return let(F.struct(place(i).alias("entering"), F.when(i >= WINDOW, place(i - WINDOW)).otherwise(F.lit(-1)).alias("leaving")), moved)

    return F.aggregate(F.sequence(F.lit(0), F.length(run) - 1), start, step,
                       lambda a: F.struct(a["first"].alias("from"), a["last"].alias("to")))


def entropy_spans(text: Column, base: Column) -> Column:
    """The spans that the entropy adds to the base spans."""
    allowed = lambda x: reduce(lambda a, b: a | b, (x.rlike(p) for p in ALLOWED))
    runs = F.filter(matches_of(text, CANDIDATE), lambda x: ~allowed(x["match"]))
    hot = F.transform(runs, lambda x: let(hot_range(x["match"]), lambda h: F.struct(
        (x["start"] + h["from"]).alias("start"), F.lit(KINDS.index(ENTROPY)).alias("kind"),
        F.when(h["from"] < 0, F.lit(-1)).otherwise(x["start"] + h["to"]).alias("end"))))
    # The base spans are in order: how far they cover the span without a gap.
    covered = lambda x: F.aggregate(base, x["start"], lambda at, b: F.when(
        b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))
    return F.filter(hot, lambda x: (x["end"] >= 0) & (covered(x) < x["end"]))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, base, spans): spans are arrays of (start, kind, end), in order."""
    rows = ensure_parallelism(df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    with_base = rows.withColumn("base", base_spans(F.col("text")))
    return with_base.select(
        F.col("key").alias(key), F.col("text").alias(text), "base",
        let(F.col("base"), lambda b: F.array_sort(F.concat(b, entropy_spans(F.col("text"), b)))).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<string>").alias("out"))

    def step(a, s):
        fresh = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(
            F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(MARK)))).otherwise(a["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))))


def without_secrets(df: DataFrame, text: str, n_chars: str | None = None) -> DataFrame:
    """The rows of ``df`` (all columns) with the spans of their text replaced; ``n_chars`` is a column with its length."""
    found = find_secrets(packed(df, text), "row", "text")
    clean = found.select("row", redact(F.col("text"), F.col("spans")).alias("clean"), (F.size("spans") > 0).alias("hit"))
    new = {text: F.when(F.col("hit"), F.col("clean")).otherwise(F.col("row")[text])}
    if n_chars:
        new[n_chars] = F.when(F.col("hit"), F.length("clean").cast(df.schema[n_chars].dataType)).otherwise(F.col("row")[n_chars])
    return clean.select(*(new.get(c, F.col("row")[c]).alias(c) for c in df.columns))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"), "doc_id", "text")

    def count(spans, kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count(F.col("base"), "assign"), count(F.col("base"), "access"), count(F.col("base"), "hex"),
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        count(F.col("spans"), ENTROPY))
