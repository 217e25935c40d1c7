"""Secret scan: fixed patterns, and strings that a character Markov model finds random rather than ordinary."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, running
from .store import free, stash

_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
#: The patterns, in the order of the kinds.
ASSIGN = "(" + "|".join(_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Strings that the model judges, words it learns from, and the symbols it knows; others count as one more symbol.
CANDIDATE, LEARNED = "[A-Za-z0-9+/_=-]{12,}", "(?<![A-Za-z0-9+/_=-])[A-Za-z][a-z]{7,}(?![A-Za-z0-9+/_=-])"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least sum and mean of the log-likelihood ratio (nats) of a finding; see ``ratios``.
LEAST_SUM, LEAST_MEAN, DRAW = 10.0, 0.4, 20.0
_SIZE = len(SYMBOLS) + 1
_SPANS = "array<struct<start:int,kind:int,end:int,what:string>>"


def _located(text: Column, pattern: str, kind: int) -> Column:
    """Spans (start, kind, end, text) of the matches of one pattern: each starts after the lengths of what stands before."""

    def spans(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("own"), m.alias("what")))

        def placed(x: Column) -> Column:
            before = running(F.transform(x, lambda v: v["gap"] + v["own"]), F.lit(0), lambda a, b: a + b)
            return let(before, lambda at: F.transform(x, lambda v, i: F.struct(
                (F.get(at, i) + v["gap"]).alias("start"), F.lit(kind).alias("kind"), (F.get(at, i) + v["gap"] + v["own"]).alias("end"), v["what"].alias("what"))))

        return F.when(F.size(found) == 0, F.array().cast(_SPANS)).otherwise(let(steps, placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and kind."""
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = let(_located(text, ASSIGN, 0), lambda x: F.when(F.size(x) == 0, x).otherwise(
        F.transform(F.filter(F.zip_with(x, value, lambda s, v: F.struct(s.alias("s"), F.length(v).alias("n"))), lambda p: p["n"] >= 8), lambda p: p["s"])))
    return F.array_sort(F.concat(assign, _located(text, ACCESS, 1), _located(text, HEX, 2)))


def overlaid(text: Column, spans: Column, cover) -> Column:
    """``text`` with the union of ``spans`` (by start) covered: ``cover`` gives the string for so many characters.

    UTF-32 makes every place reachable at once, so the work is in proportion to the text.
    """

    def covered(raw: Column) -> Column:
        cut = lambda a, n: F.decode(F.substring(raw, 4 * a + 1, 4 * n), "UTF-32")
        upto = running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

        def pieces(at: Column) -> Column:
            piece = lambda s, i: let(F.get(at, i), lambda a: F.concat(
                F.when(s["start"] > a, cut(a, s["start"] - a)).otherwise(""), F.when(s["end"] > a, cover(s["end"] - F.greatest(s["start"], a))).otherwise("")))
            return F.concat(F.array_join(F.transform(spans, piece), ""), cut(F.element_at(at, -1), F.length(text)))

        return let(upto, pieces)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.encode(text, "UTF-32"), covered))


def _codes(word: Column) -> Column:
    """Symbol numbers from 0 of the characters of a string."""
    return F.transform(F.split(word, ""), lambda c: F.when(c == "", _SIZE - 1).otherwise((F.instr(F.lit(SYMBOLS), c) + _SIZE - 1) % _SIZE))


def _ordinary(word: Column) -> Column:
    """Identifiers made of a word: itself, its halves joined in three ways, and with a number."""
    half = F.floor(F.length(word) / 2).cast("int")
    a, b = F.substring(word, F.lit(1), half), F.substring(word, half + 1, F.length(word))
    return F.array(word, F.concat_ws("_", a, b), F.concat(F.initcap(a), F.initcap(b)), F.upper(F.concat_ws("_", a, b)), F.concat(word, (F.length(word) % 10).cast("string")))


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of symbols, random over ordinary, as a table of ``_SIZE`` squared numbers.

    Labelled samples, each distinct string of all documents once: values of the fixed patterns are random, and so is the
    base64 of every word's md5; words of eight and more letters, small but for the first, that are no such value are
    ordinary, and so are the identifiers made of them. The counts that reach the driver are at most two tables.
    """
    text = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = F.concat(F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    listed = F.concat(F.transform(found, lambda v: F.struct(v.alias("w"), F.lit(1).alias("label"))), F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(LEARNED), F.lit(0))), lambda v: F.struct(v.alias("w"), F.lit(0).alias("label"))))
    words = stash(text.select(F.explode(listed).alias("x")).groupBy("x.w").agg(F.max("x.label").alias("label")), "op7-words")
    samples = F.when(F.col("label") == 1, F.array("w")).otherwise(_ordinary(F.col("w")))
    made = words.where("label = 0").select(F.lit(1).alias("label"), F.rtrim(F.base64(F.unhex(F.md5("w"))), F.lit("=")).alias("w"))
    codes = words.select("label", F.explode(samples).alias("w")).unionByName(made).select("label", _codes(F.col("w")).alias("c"))
    pairs = codes.select("label", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * _SIZE + b)).alias("p"))
    counts = [[0] * _SIZE**2 for _ in range(2)]
    for label, p, n in pairs.groupBy("label", "p").count().collect():
        counts[label][p] += n
    free(words)
    return ratios(counts)


def ratios(counts: list[list[float]]) -> list[float]:
    """Log of the share of each pair among those that begin alike, random over ordinary. Shares are drawn to those of the
    second symbol alone by ``DRAW`` pairs' worth."""
    shares = []
    for c in counts:
        single = [sum(c[b::_SIZE]) + 0.5 for b in range(_SIZE)]
        whole = sum(single)
        starts = [sum(c[a * _SIZE : (a + 1) * _SIZE]) + DRAW for a in range(_SIZE)]
        shares.append([(c[i] + DRAW * single[i % _SIZE] / whole) / starts[i // _SIZE] for i in range(_SIZE**2)])
    return [math.log(r) - math.log(o) for o, r in zip(*shares, strict=True)]


def secret_scan(docs: DataFrame, model: list[float] | None = None, keep: str = "doc_id") -> DataFrame:
    """``keep`` (doc_id), base (findings of the fixed patterns) and findings (those and the model's; arrays of start, kind,
    end, what; by start and kind) of each row of ``docs`` (doc_id, text).

    The model judges strings of 12 and more characters of ``CANDIDATE`` in what the base leaves of a text; shorter ones are
    not judged. Positions are code points, end exclusive. A null or empty text has no findings; long texts are scanned
    whole; repeated rows are judged alike; other columns are not read; an empty table gives an empty result.
    """
    model = train(docs) if model is None else model
    table = F.expr("cast(split('" + ",".join(f"{x:.6g}" for x in model) + "', ',') as array<double>)")
    rows = docs.select(keep, F.coalesce(F.col("text"), F.lit("")).alias("text")).select(F.col(keep), F.col("text"), base_spans(F.col("text")).alias("base"))
    rows = rows.select(keep, "base", overlaid(F.col("text"), F.col("base"), lambda n: F.repeat(F.lit(" "), n)).alias("rest"))
    rows = rows.select(keep, "base", _located(F.col("rest"), CANDIDATE, 3).alias("maybe"))

    def random(s: Column) -> Column:
        def judged(c: Column) -> Column:
            steps = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.get(table, a * _SIZE + b))
            return let(F.aggregate(steps, F.lit(0.0), lambda x, y: x + y), lambda x: (x >= LEAST_SUM) & (x >= LEAST_MEAN * (F.size(c) - 1)))

        return let(_codes(s["what"]), judged)

    return rows.select(keep, "base", F.when(F.size("maybe") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", F.filter("maybe", random)))).alias("findings"))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def without_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark`` in the text, and n_chars, where there is such a column, brought in line.

    Null, empty and repeated rows and empty tables are kept as they are; all other columns too.
    """
    model = train(docs)
    rows = secret_scan(docs.select(F.struct("*").alias("_row"), "text"), model, "_row")
    text = overlaid(F.col("_row.text"), F.col("findings"), lambda n: F.lit(mark))
    out = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.size("findings") == 0, F.col("_row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in out.items()])


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query; null, empty and repeated rows and empty tables as in ``secret_scan``."""
    rows = secret_scan(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("findings")).alias("spans"))
