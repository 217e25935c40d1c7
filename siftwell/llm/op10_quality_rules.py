"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, words_of

#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is for that it as was with be on not he by are this from or an at "
    "der die das und ist von den des ein eine zu mit im nicht auf für als auch "
    "le la les de des et est un une du que dans pour par sur pas "
    "el los las y en un una que por con para del se no es"
)
#: Thresholds: measure, least, most; stop_word_ratio is the share of STOP_WORDS that the text has. A text passes if every measure that is not null lies within its bounds.
RULES = (
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.25),
    ("dup_line_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("shouting_ratio", None, 0.7),
)
#: Words below which the stop words of a text say nothing: the ratio is null there, so short texts pass that rule.
LEAST_JUDGED = 50
#: The base rule: least words, and most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8


def _repeated(words: Column, n: int = WINDOW) -> Column:
    """Words inside ``n``-word windows that stand twice or more in the text, the first time included."""

    def measured(h: Column) -> Column:
        def of(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            at = F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))
            at = F.array_sort(F.filter(at, lambda x: x.isNotNull()))
            step = lambda acc, x: F.struct((acc["sum"] + F.least(F.lit(n), x - acc["end"])).alias("sum"), x.alias("end"))
            return F.aggregate(at, F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("end")), step, lambda acc: acc["sum"])

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, of))

    size = F.size(words)

    def shifted(h: Column, by: int) -> Column:
        return F.zip_with(F.slice(h, 1, F.size(h) - by), F.slice(h, 1 + by, F.size(h) - by), lambda a, b: F.xxhash64(a, b))

    one = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(one, lambda a: let(shifted(a, 1), lambda b: let(shifted(b, 2), lambda c: shifted(c, 4))))
    return F.when(size <= n, 0).otherwise(let(windows, measured))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each row of ``docs``; of null and empty texts all are 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS.split())])
    big = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(F.array_intersect(stops, F.col("words"))) / F.size(stops)).alias("stops"),
        big.cast("long").alias("n_capitals"),
    )


def quality(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The base measures and a verdict for each row of ``docs`` (doc_id, text; other columns are not read).

    A null or empty text has no words and fails the base rule. Ratios over no words or lines are null and pass. Rows
    are judged one by one, so repeated rows agree; an empty table gives an empty result.
    """
    m = measures(docs)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    values = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "stop_word_ratio": F.when(F.col("n_words") >= LEAST_JUDGED, F.col("stops")),
        "shouting_ratio": ratio("n_capitals", "word_chars"),
    }
    good = F.lit(True)
    for name, least, most in rules:
        within = F.lit(True)
        within = within & (values[name] >= least) if least is not None else within
        within = within & (values[name] <= most) if most is not None else within
        good = good & F.coalesce(within, F.lit(True))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & good).alias("kept"))


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT r, i, list_slice(ws, i, i + 7) AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i) WHERE len(ws) >= 8),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win),
gap AS (SELECT r, least(8, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -8)) AS k FROM dup WHERE n > 1),
rep AS (SELECT r, sum(k)::BIGINT AS n_repeat_words FROM gap GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
  len(list_intersect([{_STOPS}], ws)) / len([{_STOPS}]) AS stops,
  length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) AS n_capitals FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2.0 AND 20.0, true) AND coalesce(n_symbols / n_words <= 0.25, true)
  AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true) AND (n_words < 50 OR stops >= 0.02)
  AND coalesce(n_capitals / nullif(word_chars, 0) <= 0.7, true) AS kept FROM f
"""
