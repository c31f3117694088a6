"""Secret scans with a randomness test battery, in DataFrame functions only.

Three patterns give the base spans: assignments to names such as ``password``,
access keys, and long hexadecimal strings.  Beyond these, every token of 20 or
more characters that holds a letter and a digit is tested (a random token of 24
characters lacks a digit with probability 0.007 in base 32, 0.015 in base 62;
words and numbers of one kind of character are not tested):

1. Its encoding is inferred from its characters (hex, base 32, 36, 62 or 64),
   which fixes the alphabet of A characters.
2. Chi-squared statistic of the character counts against uniform use of the
   alphabet.  Under "ordinary text" it is about normal with mean
   (A - 1) + n * L and variance 2 * (A - 1) + 4 * n * L, where L = A * IC - 1 and
   IC is the index of coincidence of ordinary text: a low value speaks for random.
3. Runs of letters and of digits (signs left out): names and paths change between
   the two ``CHANGES`` times a character, about a Poisson number, random tokens
   far more often; ``2 (sqrt(changes) - sqrt(mean))`` is about normal.
4. The two deviates are added (over the root of 2) and the tail of the sum is the
   p-value: longer tokens give smaller ones for the same uniformity.
5. A random token must also pass Wald-Wolfowitz runs above and below the middle of
   the alphabet, lag-1 serial correlation, and the upper tail of the chi-squared
   statistic under uniformity (Wilson-Hilferty): absolute deviates up to ``deviate``.
6. False-discovery control per document: weighted Benjamini-Hochberg over the
   p-values at level ``rate``, the weights in proportion to the tokens' lengths.

A token that passes is a span of kind ``random``.  Offsets are code points, ends
exclusive.  One projection, no shuffle, no Python on the executors.  Null texts
count as empty; every row is scanned by itself, so ties and repeated rows need
no rule; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are too short fail at every start inside them, so the least lengths may stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ASSIGN_CUE = r"(?i:passw|secret|token|api_?key)"
ASSIGN_LEAST = 6

#: Encoding -> (pattern, alphabet, index of coincidence of ordinary text in it), tried in this order.
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.26),
    "base32": (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.0667),
    "base36": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.0667),
    "base62": (r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.0667),
    "base64": (r"^[0-9A-Za-z+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.0667),
}

#: Code points of the pieces in which a text is redacted.
PIECE = 4096

#: Changes between letters and digits of ordinary names: for each character, and in all.
CHANGES, CHANGES_MORE = 0.06, 0.5

SPANS = "array<struct<start:int,end:int,text:string,value:string>>"


def lower_tail(z: Column) -> Column:
    """Normal distribution function (Abramowitz and Stegun 26.2.17, absolute error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_spans(rows: DataFrame, name: str, pattern: str, cue: str | None = None, group: int = 0, chunk: int = 64) -> DataFrame:
    """Adds the column ``name``: array of (start, end, text, value of the group) of the pattern's matches in ``t``.

    The offsets add up over the stretches between matches.  The spans found so
    far are kept in chunks, so that a step of the walk copies one chunk and not
    all that came before.
    """
    there = F.col("t").rlike(cue or pattern)
    rows = rows.select(
        "*",
        F.when(there, F.split("t", pattern, -1)).alias("between"),
        F.when(there, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("found"),
        (F.when(there, F.regexp_extract_all("t", F.lit(pattern), F.lit(group))) if group else F.lit(None).cast("array<string>")).alias("groups"),
    )
    size = F.size("found")

    def step(acc: Column, i: Column) -> Column:
        text = F.get("found", i)
        start = acc["at"] + F.length(F.get("between", i))
        value = F.get("groups", i) if group else F.lit(None).cast("string")
        span = F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"), value.alias("value"))
        return F.struct((start + F.length(text)).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def chunk_step(acc: Column, c: Column) -> Column:
        own = F.aggregate(
            F.sequence(c, F.least(c + chunk, size) - 1),
            F.struct(acc["at"].alias("at"), F.array().cast(SPANS).alias("out")),
            step,
        )
        return bind(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), size - 1, F.lit(chunk)), begin, chunk_step, lambda acc: F.flatten(acc["out"]))
    return rows.withColumn(name, F.when(size > 0, walked).otherwise(F.array().cast(SPANS))).drop("between", "found", "groups")


def with_random(rows: DataFrame, tokens: str, name: str, deviate: float, rate: float) -> DataFrame:
    """Adds the column ``name``: those of the spans in ``tokens`` that the battery takes for random."""

    def by_encoding(text: Column, what) -> Column:
        first, *rest = ENCODINGS.values()
        out = F.when(text.rlike(first[0]), F.lit(what(first)))
        for e in rest:
            out = out.when(text.rlike(e[0]), F.lit(what(e)))
        return out

    def inferred(s: Column) -> Column:
        text = s["text"]
        one_case = text.rlike("^(?:[0-9A-F]+|[0-9A-Z]+)$") & ~text.rlike("^[A-Z2-7]+$")
        bare = F.rtrim(F.when(one_case, F.lower(text)).otherwise(F.translate(text, "-_", "+/")), F.lit("="))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            by_encoding(text, lambda e: e[1]).alias("alphabet"),
            by_encoding(text, lambda e: e[2]).alias("ic"),
            bare.alias("bare"),
            F.regexp_extract_all(bare, F.lit("(?s)."), F.lit(0)).alias("chars"),
            (F.size(F.split(F.regexp_replace(text, "[^0-9A-Za-z]", ""), "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", -1)) - 1).cast("double").alias("changes"),
        )

    def counted(s: Column) -> Column:
        squares = F.aggregate(
            F.array_distinct(s["chars"]),
            F.lit(0.0),
            lambda acc, c: acc + F.pow((F.length(s["bare"]) - F.length(F.replace(s["bare"], c, F.lit("")))).cast("double"), F.lit(2.0)),
        )
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["ic"].alias("ic"),
            s["changes"].alias("changes"),
            F.length(s["alphabet"]).cast("double").alias("a"),
            F.size(s["chars"]).cast("double").alias("n"),
            squares.alias("squares"),
            F.transform(s["chars"], lambda c: F.instr(s["alphabet"], c) - 1.0).alias("v"),
        )

    def summed(s: Column) -> Column:
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
        lagged = F.zip_with(F.slice(s["v"], F.lit(1), (s["n"] - 1).cast("int")), F.slice(s["v"], F.lit(2), (s["n"] - 1).cast("int")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        upper = lambda x: (x >= s["a"] / 2).cast("double")
        return bind(
            F.struct(total(s["v"]).alias("sum"), total(F.transform(s["v"], lambda x: x * x)).alias("sum2"), lagged.alias("lagged")),
            lambda o: F.struct(
                *[s[c].alias(c) for c in ("start", "end", "ic", "changes", "a", "n")],
                (s["squares"] * s["a"] / s["n"] - s["n"]).alias("x2"),
                total(F.transform(s["v"], upper)).alias("n1"),
                (1 + total(F.transform(o["lagged"], lambda p: (upper(p["x"]) != upper(p["y"])).cast("double")))).alias("runs"),
                (o["sum2"] - o["sum"] * o["sum"] / s["n"]).alias("spread"),
                total(
                    F.transform(o["lagged"], lambda p: (p["x"] - o["sum"] / s["n"]) * (p["y"] - o["sum"] / s["n"]))
                ).alias("lag"),
            ),
        )

    def judged(s: Column) -> Column:
        ordinary = s["n"] * (s["a"] * s["ic"] - 1)
        z_text = (s["x2"] - (s["a"] - 1) - ordinary) / F.sqrt(2 * (s["a"] - 1) + 4 * ordinary)
        z_changes = 2 * (F.sqrt(s["changes"]) - F.sqrt(CHANGES * (s["n"] - 1) + CHANGES_MORE))
        z_random = (z_text - z_changes) / F.sqrt(F.lit(2.0))
        shrink = 2 / (9 * (s["a"] - 1))
        z_uniform = (F.pow(F.greatest(s["x2"], F.lit(0.0)) / (s["a"] - 1), F.lit(1 / 3)) - (1 - shrink)) / F.sqrt(shrink)
        twice = 2 * s["n1"] * (s["n"] - s["n1"])
        runs_var = twice * (twice - s["n"]) / (s["n"] * s["n"] * (s["n"] - 1))
        runs_ok = (runs_var > 0) & (F.abs(s["runs"] - 1 - twice / s["n"]) <= deviate * F.sqrt(F.greatest(runs_var, F.lit(0.0))))
        serial_ok = (s["spread"] > 0) & (F.abs(s["lag"]) * F.sqrt(s["n"]) <= deviate * s["spread"])
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["n"].alias("n"), lower_tail(z_random).alias("p"),
            (runs_ok & serial_ok & (z_uniform <= deviate)).alias("passes"),
        )

    mixed = F.filter(tokens, lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))
    rows = rows.withColumn("_1", F.transform(mixed, inferred))
    rows = rows.withColumn("_2", F.transform(F.filter("_1", lambda s: s["alphabet"].isNotNull() & (F.size(s["chars"]) >= 16)), counted))
    rows = rows.withColumn("_3", F.transform("_2", summed)).withColumn("_4", F.transform("_3", judged))
    mean = F.aggregate("_4", F.lit(0.0), lambda acc, s: acc + s["n"]) / F.size("_4")
    rows = rows.withColumn("_5", F.array_sort(F.transform("_4", lambda s: s["p"] * mean / s["n"])))
    limit = F.array_max(F.filter(F.transform("_5", lambda p, i: F.when(p <= rate * (i + 1) / F.size("_5"), p)), lambda p: p.isNotNull()))
    rows = rows.withColumn("_6", F.when(F.size("_5") > 0, limit)).withColumn("_7", F.when(F.size("_4") > 0, mean))
    chosen = F.filter("_4", lambda s: s["passes"] & (s["p"] * F.col("_7") / s["n"] <= F.col("_6")))
    return rows.withColumn(name, F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).drop(*[f"_{k}" for k in range(1, 8)])


def with_secrets(rows: DataFrame, deviate: float, rate: float) -> DataFrame:
    """Adds ``base`` and ``secrets``: arrays of (start, k, end) in order, k the place of the kind in ``KINDS``.

    ``rows`` has the text in the column ``t``.
    """
    rows = with_spans(rows, "assign", ASSIGN, cue=ASSIGN_CUE, group=2)
    rows = with_spans(rows, "access", ACCESS)
    rows = with_spans(rows, "hex", HEX)
    rows = with_spans(rows, "tokens", TOKEN)
    rows = with_random(rows, "tokens", "random", deviate, rate)

    def marked(kind: str) -> Column:
        spans = F.filter(kind, lambda s: F.length(s["value"]) >= ASSIGN_LEAST) if kind == "assign" else F.col(kind)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))

    rows = rows.select("*", *[marked(k).alias(f"_{k}") for k in KINDS]).drop("tokens", *KINDS)
    base = F.array_sort(F.concat("_assign", "_access", "_hex"))
    rows = rows.withColumn("base", base).withColumn("secrets", F.array_sort(F.concat("base", "_random")))
    return rows.drop(*[f"_{k}" for k in KINDS])


def joined(spans: str) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, deviate: float = 3.29, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and a digest of the base spans, and all spans as text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = with_secrets(rows, deviate, rate)
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("secrets").alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", deviate: float = 3.29, rate: float = 0.01, text_col: str = "text") -> DataFrame:
    """``docs`` (same columns) with every secret in the text replaced; overlapping spans are replaced as one."""
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col(text_col).cast("string").alias("t"))
    rows = with_secrets(rows, deviate, rate)
    some = F.size("secrets") > 0
    rows = rows.withColumn("pieces", F.when(some, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    rows = rows.withColumn("gaps", F.when(some, gaps("secrets"))).withColumn("gaps", F.filter("gaps", lambda g: g["to"] >= g["from"]))
    kept = F.transform("gaps", lambda g: F.concat(stretch("pieces", g["from"], g["to"]), F.lit(mark)))
    last = F.array_max(F.transform("secrets", lambda s: s["end"]))
    text = F.when(some, F.concat(F.array_join(kept, ""), stretch("pieces", last, F.length("t")))).otherwise(F.col("t"))
    return rows.withColumn("clean", text).select(*[F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns])


def gaps(spans: str, chunk: int = 64) -> Column:
    """For each of the sorted spans (from, to): from the largest end before it to its start (none, where to < from)."""
    struct = "struct<from:int,to:int>"

    def step(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["at"].alias("from"), s["start"].alias("to"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap)).alias("out"))

    def chunk_step(acc: Column, c: Column) -> Column:  # a step copies one chunk and not all that came before
        begin = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{struct}>").alias("out"))
        own = F.aggregate(F.slice(spans, c + 1, F.lit(chunk)), begin, step)
        return bind(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{struct}>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(chunk)), begin, chunk_step, lambda acc: F.flatten(acc["out"]))


def stretch(pieces: str, first: Column, end: Column) -> Column:
    """The code points from ``first`` to before ``end`` of a text cut into pieces of ``PIECE``: walks into the outer two pieces only."""
    at = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    low, high = F.floor(first / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    inner = F.array_join(F.slice(pieces, low + 2, F.greatest(high - low - 1, F.lit(0))), "")
    several = F.concat(F.substring(at(low), first % PIECE + 1, F.lit(PIECE)), inner, F.substring(at(high), F.lit(1), end % PIECE))
    return F.when(low == high, F.substring(at(low), first % PIECE + 1, end - first)).otherwise(several)
