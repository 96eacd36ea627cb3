"""Secret scan: three written patterns, and sliding-window Shannon entropy over candidate strings.

Kinds and spans (code points, end exclusive):

- ``assign``, ``access``, ``hex``: matches of the written patterns, leftmost first and not overlapping within a kind; matches that are too
  short are dropped after matching.
- ``entropy``: a maximal run of at least 20 characters of ``[A-Za-z0-9+/_=-]`` with a digit or an upper-case letter after a lower-case one,
  in which some window of 20 characters has an entropy of at least the threshold of its character class. The window moves one
  character at a time and the entropy follows from the counts of the character that leaves and the one that enters. Spans of another
  kind, rulers (a character eight times or more) and words of the allow-list are cut out of a run and each part of 20 characters or more that is
  left is judged by itself; parts that are an allowed whole (a UUID, a date, a path of plain words) are suppressed.

Only built-in functions are used and nothing is shuffled. Defined results: null and empty texts have no span; every row keeps its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.batches import numbered

# The written patterns, with the least length of the group that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
MARK = "[SECRET]"

WINDOW = 20
PART = r"[0-9]|[a-z][A-Z]"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_=-]{20,}"
# Character classes, the first that fits counts, with the least entropy (bits a character) of a window. Digits alone cannot reach theirs.
CLASSES = [("digits", r"^[0-9]+$", 9.9), ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.05), ("upper", r"^[0-9A-Z]+$", 3.45), ("any", r"^", 3.65)]
RULERS = "|".join(f"{c if c.isalnum() else chr(92) + c}{{8,}}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
CUT = rf"(?i:example|sample|placeholder|dummy|changeme|redacted|lorem)|{RULERS}"
ALLOWED = [
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^(?i:sha(?:1|256|384|512))-",  # integrity values of public files
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[A-Za-z0-9_-]*$",  # dates
    r"^(?:/?[a-z]+[0-9]{0,4}[/_-])+[a-z]*[0-9]{0,4}/?$",  # paths and slugs of plain words
]


def spans_of(text: Column, kind: str, pattern: str, least: int, group: int = 0) -> Column:
    """Spans of a pattern as ``array<struct<start, ord, kind, end, found>>``; ``least`` holds for the given group's length."""
    ord_ = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    cell = F.struct(F.lit(0).alias("start"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), F.lit(0).alias("end"), F.lit("").alias("found"))
    cells = F.array(cell).cast("array<struct<start:int,ord:int,kind:string,end:int,found:string>>")
    start = F.struct(F.lit(0).alias("at"), F.slice(cells, 1, 0).alias("spans"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + F.length(m["gap"])
        end = begin + F.length(m["found"])
        span = F.struct(begin.alias("start"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), m["found"].alias("found"))
        return F.struct(end.alias("at"), F.when(F.length(m["inner"]) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    matches = F.filter(F.arrays_zip(between.alias("gap"), found.alias("found"), inner.alias("inner")), lambda m: m["found"].isNotNull())
    return F.when(text.rlike(pattern if group else f"(?:{pattern[:-1]}){{{least},}}" if kind == "hex" else pattern),
                  F.aggregate(matches, start, step, lambda s: s["spans"])).otherwise(F.slice(cells, 1, 0))


def window_entropy(run: Column, width: int = WINDOW) -> Column:
    """Largest Shannon entropy of a window of ``width`` characters in ``run``, by incremental counts."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    at = lambda c: F.get(weight, c)

    def step(state: Column, i: Column) -> Column:
        first = F.greatest(i - width, F.lit(1))
        before = F.substring(run, first, i - first)
        leaves = F.when(i > width, F.substring(run, first, F.lit(1)))
        kept = F.when(i > width, F.substring(before, F.lit(2), F.lit(width))).otherwise(before)
        enters = F.substring(run, i, F.lit(1))
        out, in_ = count(before, leaves), count(kept, enters)
        s = state["s"] + at(in_ + 1) - at(in_) - F.when(i > width, at(out) - at(out - 1)).otherwise(0.0)
        return F.struct(s.alias("s"), F.when(i >= width, F.least(state["low"], s)).otherwise(state["low"]).alias("low"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(1e9).alias("low"))
    return F.aggregate(F.sequence(F.lit(1), F.length(run)), start, step, lambda st: F.lit(math.log2(width)) - st["low"] / width)


def threshold_of(run: Column) -> Column:
    out = F.when(run.rlike(CLASSES[0][1]), CLASSES[0][2])
    for _, pattern, bits in CLASSES[1:]:
        out = out.when(run.rlike(pattern), bits)
    return out


def allowed(run: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | run.rlike(pattern)
    return out


def parts_of(run: Column, base: Column) -> Column:
    """What is left of a run, in parts of a window's length or more, when spans of other kinds, rulers and allowed words are cut out."""
    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    words = F.transform(spans_of(run["found"], "entropy", CUT, 1), lambda w: F.struct((run["start"] + w["start"]).alias("start"), (run["start"] + w["end"]).alias("end")))
    end = F.struct(run["end"].alias("start"), run["end"].alias("end"))
    cuts = F.array_sort(F.concat(F.transform(touching, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))), words, F.array(end)))

    def step(state: Column, cut: Column) -> Column:
        part = F.struct(state["at"].alias("start"), F.lit(KINDS.index("entropy")).alias("ord"), F.lit("entropy").alias("kind"), cut["start"].alias("end"),
                        F.substring(run["found"], state["at"] - run["start"] + 1, cut["start"] - state["at"]).alias("found"))
        return F.struct(F.greatest(state["at"], cut["end"]).alias("at"),
                        F.when(cut["start"] - state["at"] >= WINDOW, F.concat(state["parts"], F.array(part))).otherwise(state["parts"]).alias("parts"))

    nothing = F.slice(F.array(run), 1, 0)
    left = F.aggregate(cuts, F.struct(run["start"].alias("at"), nothing.alias("parts")), step, lambda s: s["parts"])
    return F.when((F.size(touching) == 0) & ~run["found"].rlike(CUT), F.array(run)).otherwise(left)


def secret_spans(docs: DataFrame, text_col: str = "text", column: str = "secret_spans") -> DataFrame:
    """Add ``column`` (or replace it): the spans of each text, ``array<struct<start, ord, kind, end, found>>`` by start and kind."""
    inner = numbered(docs)
    text = F.coalesce(F.col(f"c{docs.columns.index(text_col)}"), F.lit(""))
    base = F.concat(spans_of(text, "assign", ASSIGN, 6, 1), spans_of(text, "access", ACCESS, 20), spans_of(text, "hex", HEX, 24))
    out = inner.withColumn("_base", base)
    parts = F.flatten(F.transform(spans_of(text, "entropy", CANDIDATE, WINDOW), lambda r: parts_of(r, F.col("_base"))))
    runs = F.filter(parts, lambda r: r["found"].rlike(PART) & ~allowed(r["found"]) & (window_entropy(r["found"]) >= threshold_of(r["found"])))
    found = out.withColumn("_spans", F.array_sort(F.concat("_base", runs))).drop("_base")
    kept = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c != column]
    return found.select(*[c for c, _ in kept], "_spans").toDF(*[c for _, c in kept], column)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = MARK, length_col: str | None = None) -> DataFrame:
    """Replace every span (overlapping ones as one) by ``mark``; ``length_col`` of a changed text becomes its new length, all else stays."""
    inner = numbered(docs)
    name = f"c{docs.columns.index(text_col)}"
    text = F.col(name)

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        fresh = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(fresh | (state["at"] == 0), F.concat(state["out"], F.array(F.concat(gap, F.lit(mark))))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))  # overlapping spans: the first has put the mark
    clean = F.aggregate("_spans", start, step, lambda st: F.concat(F.array_join(st["out"], ""), F.substring(text, st["at"] + 1, F.length(text))))
    out = secret_spans(inner, name, "_spans").withColumn(name, F.when(F.size("_spans") == 0, text).otherwise(clean))
    if length_col in docs.columns:
        size = f"c{docs.columns.index(length_col)}"
        out = out.withColumn(size, F.when(F.size("_spans") == 0, F.col(size)).otherwise(F.length(name).cast(docs.schema[length_col].dataType)))
    return out.select(*inner.columns).toDF(*docs.columns)
