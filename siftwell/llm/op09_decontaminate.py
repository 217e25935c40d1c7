"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, then weighted-shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, words_of
from .store import join_small, stash

WORDS, LEAST, RADIUS = 5, 0.75, 20


def _lowered(text: Column) -> Column:
    return words_of(F.lower(text))


def _grams(words: Column, n: int) -> Column:
    """Fingerprints of the ``n``-word shingles by position."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    one = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, let(hashes, one)).otherwise(F.array().cast("array<bigint>"))


def simhash(grams: Column) -> Column:
    """64 bits, each the majority of that bit over the shingles.

    The votes of three bits are counted at once, in three lanes of 21 bits of a sum.
    """

    def votes(j: int) -> Column:
        lanes = sum(1 << (21 * k) for k in range(3) if j + 22 * k < 64)
        word = lambda g: sum((F.shiftleft(F.shiftrightunsigned(g, j + 22 * k).bitwiseAND(F.lit(1).cast("long")), 21 * k) for k in range(1, 3) if j + 22 * k < 64), F.shiftrightunsigned(g, j).bitwiseAND(F.lit(1).cast("long")))
        total = F.aggregate(grams, F.lit(0).cast("long"), lambda acc, g: acc + word(g))
        most = lambda t, k: F.when(2 * F.shiftrightunsigned(t, 21 * k).bitwiseAND(F.lit((1 << 21) - 1)) > F.size(grams), F.lit((1 << (j + 22 * k)) - (1 << 64) * (j + 22 * k == 63))).otherwise(F.lit(0)).cast("long")
        return let(total, lambda t: sum((most(t, k) for k in range(1, 3) if lanes >> (21 * k) & 1), most(t, 0)))

    return sum((votes(j) for j in range(1, 22)), votes(0))


def _blocks(print_: Column, radius: int) -> Column:
    """``radius + 1`` blocks of the 64 bits: fingerprints within the radius agree on one."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("k"), F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, n: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word) of each document and benchmark item it holds.

    Every window of an item's length that has a shingle of an item of that length gets a SimHash (a window without one has
    similarity 0). Multi-index blocks find all item fingerprints of that length within ``radius`` of it, and a weighted
    Jaccard similarity of the shingle sets of ``least`` or more decides. A shingle weighs one over the number of items that
    have it, others weigh one. A text shorter than an item is one window. Words are lower-cased; items of fewer than ``n``
    words are one shingle. The best window of each pair is returned, the earliest of equals. A null or empty text or item
    has no shingles and gives no row; long texts are searched whole; repeated rows give one row; an empty table gives an
    empty result; other columns are not read.
    """
    items = benchmark.select("item_id", _lowered(F.col("text")).alias("w")).where("size(w) > 0").dropDuplicates()
    items = items.select("item_id", F.size("w").alias("len"), F.least(F.size("w"), F.lit(n)).alias("n"), "w")
    by_size = lambda w, of: F.coalesce(*[F.when(of == k, _grams(w, k)) for k in range(1, n + 1)])
    items = stash(items.select("item_id", "len", "n", F.array_distinct(by_size(F.col("w"), F.col("n"))).alias("g")).withColumn("print", simhash(F.col("g"))), "op9-items")
    spots = items.select("item_id", "len", "n", F.explode("g").alias("h"))
    rarity = spots.groupBy("n", "h").agg((1.0 / F.countDistinct("item_id")).alias("wt"))
    weighed = items.select("item_id", "len", "n", "print", F.explode("g").alias("h")).join(rarity, ["n", "h"])
    weighed = weighed.groupBy("item_id", "len", "n", "print").agg(F.array_sort(F.collect_list(F.struct("h", "wt"))).alias("own"))
    spots = stash(spots.groupBy("n", "h").agg(F.collect_set("len").alias("lens")), "op9-spots")
    index = stash(weighed.select("item_id", "len", "own", F.col("print").alias("other"), F.explode(_blocks(F.col("print"), radius)).alias("b")).select("item_id", "len", "own", "other", "b.k", "b.v"), "op9-index")

    rid = F.xxhash64("doc_id", "text")
    rows = docs.select("doc_id", rid.alias("rid"), "text")
    words = _lowered(F.col("text"))
    hits = None
    for k in sorted(r[0] for r in items.select("n").distinct().collect()):  # n values at most
        grams = rows.select("doc_id", "rid", F.size(words).alias("size"), F.posexplode(_grams(words, k)).alias("at", "h"))
        part = join_small(grams, spots.where(F.col("n") == k).drop("n"), ["h"]).select("doc_id", "rid", "size", F.lit(k).alias("n"), "at", F.explode("lens").alias("len"))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return docs.select(F.col("doc_id"), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("start_word")).where("false")
    last = F.greatest(F.lit(0), F.col("size") - F.col("len"))
    ats = hits.groupBy("doc_id", "rid", "size", "n", "len").agg(F.collect_set("at").alias("ats"))  # bounded by the document
    starts = F.transform("ats", lambda at: F.sequence(F.least(last, F.greatest(F.lit(0), at - F.col("len") + F.col("n"))), F.least(at, last)))
    spans = ats.select("doc_id", "rid", "n", "len", F.array_distinct(F.flatten(starts)).alias("starts"))
    spans = stash(spans.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("n", "len", "starts")).alias("asked")), "op9-asked")  # bounded by the document
    windows = join_small(rows, spans.select("rid", "asked"), ["rid"]).select("doc_id", words.alias("w"), "asked")
    grams_of = F.transform("asked", lambda a: F.struct(a["n"].alias("n"), a["len"].alias("len"), a["starts"].alias("starts"), by_size(F.col("w"), F.least(F.size("w"), a["n"])).alias("g")))
    windows = windows.select("doc_id", F.explode(grams_of).alias("a")).select("doc_id", "a.n", "a.len", "a.g", F.explode("a.starts").alias("start"))
    windows = windows.select("doc_id", "len", "start", F.array_distinct(F.slice("g", F.col("start") + 1, F.greatest(F.lit(1), F.col("len") - F.col("n") + 1))).alias("g")).dropDuplicates(["doc_id", "len", "start", "g"])
    windows = stash(windows.withColumn("print", simhash(F.col("g"))), "op9-windows")
    near = join_small(windows.select("doc_id", "len", "start", "g", "print", F.explode(_blocks(F.col("print"), radius)).alias("b")).select("*", "b.k", "b.v").drop("b"), index, ["len", "k", "v"])
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= radius)
    near = near.where(F.col("k") == _first_block("print", "other", radius))  # a pair that meets in several blocks is looked at once
    both = F.aggregate(F.filter("own", lambda o: F.array_contains("g", o["h"])), F.lit(0.0), lambda a, o: a + o["wt"])
    mine = F.aggregate("own", F.lit(0.0), lambda a, o: a + o["wt"])
    extra = F.size(F.array_except("g", F.transform("own", lambda o: o["h"])))
    scored = near.select("doc_id", "item_id", "start", F.round(both / (mine + extra), 9).alias("similarity")).where(F.col("similarity") >= least)
    return scored.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min(F.struct(-F.col("similarity"), "start"))["start"].cast("long").alias("start_word"))


def _first_block(a: str, b: str, radius: int) -> Column:
    """Number of the first block on which two fingerprints agree."""
    same = F.zip_with(_blocks(F.col(a), radius), _blocks(F.col(b), radius), lambda x, y: F.when(x["v"] == y["v"], x["k"]))
    return F.array_min(same)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns; null and empty texts and repeated rows without one stay."""
    rid = F.xxhash64("doc_id", "text")
    bad = stash(leaks(docs.select(rid.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("rid")).distinct(), "op9-bad")
    held = docs.select(F.struct("*").alias("_row"), rid.alias("rid"))
    return join_small(held, bad, ["rid"], "left_anti").select("_row.*")


ORACLE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
i0 AS (SELECT item_id, w, len(w) AS L, least(len(w), 5) AS n FROM b WHERE len(w) > 0),
own0 AS (SELECT DISTINCT item_id, L, n, list_slice(w, o + 1, o + n) AS g FROM i0, LATERAL (SELECT unnest(range(0, L - n + 1)) AS o)),
rare AS (SELECT n, g, 1.0 / count(DISTINCT item_id) AS wt FROM own0 GROUP BY n, g),
own AS (SELECT item_id, L, n, g, wt FROM own0 JOIN rare USING (n, g)),
tot AS (SELECT item_id, sum(wt) AS mine FROM own GROUP BY item_id),
d0 AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
dg AS (SELECT doc_id, w, a, n, list_slice(w, a + 1, a + n) AS g FROM d0, (SELECT DISTINCT n FROM i0), LATERAL (SELECT unnest(range(0, len(w) - n + 1)) AS a)),
met AS (SELECT DISTINCT doc_id, w, item_id, L, own.n FROM dg JOIN own USING (n, g)),
win AS (SELECT doc_id, item_id, n, s, list_slice(w, s + 1, s + L) AS ww FROM met, LATERAL (SELECT unnest(range(0, greatest(0, len(w) - L) + 1)) AS s)),
sh AS (SELECT DISTINCT doc_id, item_id, s, list_slice(ww, k + 1, k + least(n, len(ww))) AS g FROM win, LATERAL (SELECT unnest(range(0, len(ww) - least(n, len(ww)) + 1)) AS k)),
cmp AS (SELECT sh.doc_id, sh.item_id, s, sum(own.wt) AS both_, count(*) - count(own.g) AS extra FROM sh LEFT JOIN own ON sh.item_id = own.item_id AND sh.g = own.g GROUP BY ALL),
sc AS (SELECT doc_id, item_id, s, both_ / (mine + extra) AS similarity FROM cmp JOIN tot USING (item_id))
SELECT doc_id, item_id, round(max(similarity), 9) AS similarity, arg_min(s, (-round(similarity, 9), s))::BIGINT AS start_word FROM sc WHERE similarity >= 0.75 GROUP BY doc_id, item_id
"""
