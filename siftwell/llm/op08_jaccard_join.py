"""Exact n-gram Jaccard join over a token-group matrix.

Documents are sets of shingle fingerprints; equal sets are one. If two sets have a Jaccard similarity of 0.75, each
holds a shared token among its first quarter under any one order of tokens. Tokens that a sample finds frequent
come last in that order, so passages that many documents share don't bring these together.

If the first token two sets share stands at place i of one and j of the other, they share at most as many tokens as the
smaller of what follows i and j; below the threshold, the two are not compared.

1. Groups: per token, every set is compared with the token's centre, the set where it stands foremost: among near
   copies, one with few tokens of its own, which most of them link to. Linked sets form groups.
2. Token-group matrix: the union of first-quarter tokens of each group, as rows (token, group, least and most size,
   first place). A set's overlap with a foreign group is bounded by the matrix entries it meets; groups without any, or
   whose sizes and places rule the threshold out, stay closed. Opened groups are compared set by set, where set and
   member meet at a token and their own places allow it.

Comparisons are exact. Pairs inside one group need no comparison, as they already have one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .kernel import Prefix, lower_ascii, mix, text_chunks, word_hashes, words
from .repeats import _i32, _i64, identified
from .store import free, join_small, stash

WORDS, PERCENT = 5, 75
_NO_ID = (1 << 63) - 1
#: Frequent tokens: counted in one of how many documents, least count there, and tokens at most (the most frequent).
#: They only set the order of tokens; any set of them gives the same result.
SAMPLE, FREQUENT, MOST = 8, 3, 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of the ``n``-word shingles of each document; of all words if there are fewer."""
    data = lower_ascii(data)
    starts, ends, first = words(data, offsets)
    prefix = Prefix(word_hashes(data, starts, ends))
    at = np.arange(max(len(starts) - n + 1, 0))
    grams = prefix.of(at, at + n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = dict(zip(short, prefix.of(first[short], first[short + 1]), strict=True))
    out = []
    for i, k in enumerate(count):
        if k >= n:
            s = np.sort(grams[first[i] : first[i] + k - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(np.array([whole[i]] if k else [], np.uint64))
    return out


def set_id(s: np.ndarray) -> np.uint64:
    """The same for equal sets."""
    return mix(np.array([np.add.reduce(mix(s)) + np.uint64(len(s))], np.uint64))[0]


def _rid(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("rid")).to_numpy()


def _summary(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rid, sizes, sets = batch.column(batch.schema.get_field_index("doc_id")), _rid(batch), [], []
            for _, _, data, offsets in text_chunks(batch):
                for s in shingle_sets(data, offsets, n):
                    sizes.append(len(s))
                    sets.append(set_id(s))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), _i64(rid), _i64(np.array(sets, np.uint64)), pa.array(sizes, pa.int64())], ["doc_id", "rid", "id", "n"])

    return run


def _sample_tokens(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch):
                sets = shingle_sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays([_i64(np.concatenate([np.zeros(0, np.uint64), *sets]))], ["token"])

    return run


def _first_quarter(n: int, percent: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch):
                tokens, owner, sizes, places = [], [], [], []
                for s in shingle_sets(data, offsets, n):
                    if not len(s):
                        continue
                    me = set_id(s)
                    if me in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(me)
                    size = len(s)
                    k = size - -(-percent * size // 100) + 1
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        late = frequent[at] == s
                        s = np.concatenate([s[~late][:k], s[late][: max(0, k - int((~late).sum()))]])
                    else:
                        s = s[:k]
                    tokens.append(s)
                    owner.append(np.full(len(s), me, np.uint64))
                    sizes.append(np.full(len(s), size))
                    places.append(np.arange(len(s)))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [_i64(np.concatenate(tokens)), _i64(np.concatenate(owner)), _i32(np.concatenate(sizes)), _i32(np.concatenate(places))], ["token", "id", "n", "at"]
                    )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for row, end, data, offsets in text_chunks(batch):
                blobs = [s.tobytes() for s in shingle_sets(data, offsets, n)]
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), pa.array(blobs, pa.binary())], ["id", "tokens"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(batch.schema.get_field_index("x")), batch.column(batch.schema.get_field_index("y"))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                s, t = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate([s, t]))
                same = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * same >= percent * (len(s) + len(t) - same)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text; other columns are not read).

    Two documents link if 100 times the size of their sets' intersection is ``percent`` times that of the union or more.
    component_id is the smallest doc_id reachable, the document itself included. A null or empty text has no shingles
    and no links; rows that repeat an id with one text are one document; a null id takes no part in the smallest id and
    stays null (its component_id is null if it has no other); an empty table gives an empty result.
    """
    per, root = _classes(docs, n, percent, "op8")
    least = root.groupBy("root").agg(F.min("doc").alias("least"))
    named = stash(root.join(least, "root").select("id", F.when(F.col("least") < _NO_ID, F.col("least")).alias("least")), "op8-named")
    return join_small(per, named, ["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs``, with all its columns, of the document of smallest id in each component; of several rows of
    that id and text (null ids with one text among them) the least stays. Texts without shingles all stay."""
    per, root = _classes(docs, n, percent, "near")
    first = root.groupBy("root").agg(F.min(F.struct("doc", "rid")).alias("x")).select("x.rid")
    rows = per.where("n > 0").groupBy("rid").agg((F.count(F.lit(1)) > 1).alias("several"))
    stay = first.join(rows, "rid").unionByName(per.where("n = 0").select("rid", F.lit(False).alias("several")).distinct())
    held = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "text").alias("rid"))
    kept = join_small(held, stash(stay, "near-stay"), ["rid"])
    one = kept.where("several").groupBy("rid").agg(F.min("_row").alias("_row"))  # combined before the shuffle, so no rid is hot
    return kept.where("not several").select("_row.*").unionByName(one.select("_row.*"))


def _classes(docs: DataFrame, n: int, percent: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, id, n of each row; id, doc, rid, root of each distinct set): rows of one id have equal sets."""
    rows = identified(docs).select("doc_id", "rid", "text")
    per = stash(rows.mapInArrow(_summary(n), "doc_id long, rid long, id long, n long"), f"{tag}-sets")
    counted = rows.where(F.pmod("rid", F.lit(SAMPLE)) == 0).mapInArrow(_sample_tokens(n), "token long").groupBy("token").count()
    frequent = np.sort(counted.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "token").limit(MOST).select("token").toArrow().column("token").to_numpy().view(np.uint64))

    sizes = per.where("n > 0").groupBy("id").agg(F.first("n").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "rid")).alias("x")).select("id", "n", "x.doc", "x.rid")
    sizes = stash(sizes, f"{tag}-classes")
    first = rows.select("text").mapInArrow(_first_quarter(n, percent, frequent), "token long, id long, n int, at int")
    w = Window.partitionBy("token").orderBy("at", "id")
    met = first.select("*", F.first(F.struct("id", "n", "at")).over(w).alias("rep"), F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))
    met = met.where("id != prev or (prev is null and id != next) or (id = prev and id = rep.id and id != next)").select("token", "id", "n", "at", "rep")
    met = stash(met, f"{tag}-met")
    free()

    def allowed(na: str, i: str, nb: str, j: str) -> Column:
        """Whether sets of so many tokens, the first one they share at these places, can reach the threshold."""
        return F.least(F.col(na) - F.col(i), F.col(nb) - F.col(j)) * (100 + percent) >= (F.col(na) + F.col(nb)) * percent

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        need = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(sizes.select("id", "rid"), "id")
        need = stash(need, f"{tag}-need")
        table = stash(join_small(rows.select("rid", "text"), need, ["rid"]).mapInArrow(_sets(n), "id long, tokens binary"), f"{tag}-tokens")
        sets = table.dropDuplicates(["id"])
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
        out = stash(both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"), f"{tag}-{name}")
        free(need, table)
        return out

    star = met.where("id != rep.id").where(allowed("rep.n", "rep.at", "n", "at")).select(F.least("id", "rep.id").alias("a"), F.greatest("id", "rep.id").alias("b"))
    star = stash(star.distinct(), f"{tag}-star")
    links = verified(star, "links")
    group = components(links, f"{tag}-groups")

    inside = met.select("token", "id", "n", "at").join(group.select("id", "label"), "id", "left").select("token", "id", "n", "at", F.coalesce("label", "id").alias("grp"))
    inside = stash(inside, f"{tag}-inside")
    free(met, group)
    matrix = inside.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("at").alias("place"))
    several = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    matrix = stash(matrix.join(several, "token"), f"{tag}-matrix")
    asked = inside.join(several, "token", "left_semi")
    other = matrix.select("token", F.col("grp").alias("far"), "least", "most", "place")
    most = F.least(F.col("n") - F.col("at"), F.col("most") - F.col("place"))
    open_ = asked.join(other, "token").where("grp < far").where(most * (100 + percent) >= (F.col("n") + F.col("least")) * percent)
    open_ = open_.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("i"), "far")
    member = asked.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("j"), F.col("grp").alias("far"))
    pairs = open_.join(member, ["token", "far"]).where(allowed("na", "i", "nb", "j")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stash(pairs.join(star, ["a", "b"], "left_anti"), f"{tag}-opened")
    free(inside, matrix, star)
    more = verified(pairs, "more")
    final = components(links.unionByName(more), f"{tag}-final")
    root = stash(sizes.join(final.select("id", "label"), "id", "left").select("id", "doc", "rid", F.coalesce("label", "id").alias("root")), f"{tag}-roots")
    free(pairs, links, more, final, sizes)
    return per, root


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT DISTINCT doc_id, hash(list_slice(ws, i, i + least(5, len(ws)) - 1)) AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.root, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
