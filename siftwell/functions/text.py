"""Text and record expressions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Option letters, the labels of PubMed-style decisions, and the longest context kept in a prompt.
LETTERS = "ABCDEFGHIJ"
DECISIONS = {"A": "yes", "B": "no", "C": "maybe"}
MOST_CONTEXT = 2000
#: Fixed value: white space as Python's str.split sees it.
PY_SPACE = r"(?:[\x1c-\x1f]|(?U:\s))+"


def strip(text: Column) -> Column:
    """A text without white space at either end, as Python's str.strip leaves it."""
    one = PY_SPACE[:-1]
    return F.regexp_replace(F.regexp_replace(text, rf"\A{one}++", ""), rf"(?<!{one}){one}++\z", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def make_uid(source: Column, split: Column, index: Column) -> Column:
    return F.format_string("%s/%s/%06d", source, split, index)


def full_text(title: Column, text: Column) -> Column:
    return F.when(strip(title) != "", F.concat(title, F.lit("\n\n"), text)).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Lower case; everything but letters, digits and single inner spaces goes."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(normalize_text(text), " "), "")


def py_words(text: Column) -> Column:
    return F.array_remove(F.split(text, PY_SPACE), "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), F.lit(0))


def token_cost(text: Column) -> Column:
    """Tokens of a text, one at least."""
    return F.greatest(F.lit(1), F.size(tokens(F.coalesce(text, F.lit(""))))).cast("long")


def hash_uniform(namespace: str, seed: int, uid: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, so batch and stream agree."""
    digest = F.md5(F.concat(F.lit(f"{namespace}:{seed}:"), uid))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u + 1e-12) + 1e-12)


def letter_key(index: Column) -> Column:
    """A for 0, B for 1 and so on; null out of range."""
    return F.when((index >= 0) & (index < len(LETTERS)), F.substring(F.lit(LETTERS), index + 1, F.lit(1)))


def ngram_buckets(words: Column, n: int, buckets: int) -> Column:
    """Buckets of all word n-grams of orders 1 to ``n``, repeats kept."""

    def order(words: Column, k: int) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - k)
        gram = lambda i: F.array_join(F.slice(words, i + 1, F.lit(k)), " ")
        grams = F.transform(at, lambda i: (F.crc32(gram(i).cast("binary")) % buckets).cast("int"))
        return F.when(F.size(words) >= k, grams).otherwise(F.array().cast("array<int>"))

    return let(words, lambda w: F.concat(*[order(w, k) for k in range(1, n + 1)]))


def truncate_head(contexts: Column, most: int = MOST_CONTEXT) -> Column:
    """The contexts as one text; of a long one the tail stays behind three dots."""
    joined = strip(F.array_join(contexts, "\n"))
    return F.when(F.length(joined) > most, F.concat(F.lit("..."), F.right(joined, F.lit(most)))).otherwise(joined)


def render_prompt(question: Column, options: Column, contexts: Column | None = None) -> Column:
    """Context, question and lettered options, one a line, ready for the answer."""
    lines = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"]))
    parts = [F.concat(F.lit("Question: "), question), F.array_join(lines, "\n"), F.lit("Answer:")]
    if contexts is not None:
        head = truncate_head(contexts)
        parts.insert(0, F.when(head != "", F.concat(F.lit("Context: "), head)))
    return F.concat_ws("\n", *parts)


def render_continuation(options: Column, key: Column, mode: str = "letter") -> Column:
    return F.concat(F.lit(" "), key if mode == "letter" else F.element_at(options, key))


def render_completion(answer: Column, rationale: Column | None = None) -> Column:
    out = F.concat(F.lit(" "), answer)
    if rationale is None:
        return out
    return F.concat(out, F.when(strip(rationale) != "", F.concat(F.lit("\n\nExplanation: "), strip(rationale))).otherwise(""))


def human_bytes(n: Column) -> Column:
    """A size with one decimal in units of 1024."""
    out = F.format_string("%.1f TB", n / float(1 << 40))
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB"), (0, "B")):
        out = F.when(n < float(1 << (power + 10)), F.format_string(f"%.1f {unit}", n / float(1 << power))).otherwise(out)
    return out


def fingerprint(ids: Column) -> Column:
    """Aggregate: number of distinct ids and a digest of them; ``none`` for no id."""
    every = F.array_sort(F.collect_set(ids))
    return F.when(F.size(every) == 0, "none").otherwise(F.concat(F.size(every), F.lit("@"), F.substring(F.sha2(F.array_join(every.cast("array<string>"), ","), 256), 1, 10)))
