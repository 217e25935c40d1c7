"""Scorers: one number a record, higher is better. ``fit(pool)`` learns from a pool, ``transform(df)`` adds ``score``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import gumbel, hash_uniform, let, ngram_buckets, normal_words, py_words
from ..functions.words import coded, cut, gram_crcs, sums
from ..session import written
from ..sources.registry import SCORERS
from . import bigrams
from .filters import good_question
from .select import ranked

#: Bytes of text that a task goes through at a time.
STRETCH = 8 << 20


class Scorer:
    """Without ``fit`` a scorer needs no pool. The same ``transform`` serves a pool and each batch of a stream."""

    streams = True  # if batch by batch gives the same scores

    def fit(self, pool: DataFrame) -> Scorer:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@SCORERS.register("random")
class Random(Scorer):
    def __init__(self, seed: int = 42) -> None:
        self.seed = seed

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", hash_uniform("random", self.seed, F.col("uid")))


@SCORERS.register("length")
class Length(Scorer):
    def __init__(self, unit: str = "chars") -> None:
        if unit not in ("chars", "words"):
            raise ValueError(f"unit {unit!r} is neither chars nor words")
        self.unit = unit

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", (F.length("text") if self.unit == "chars" else F.size(py_words(F.col("text")))).cast("double"))


def bucket_counts(df: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, cnt) of the n-grams of orders 1 to ``n`` of all texts; a task counts its own before they are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for rows in cut(batches, "text", STRETCH):
            for _, crc in gram_crcs(*coded(rows["text"].combine_chunks()), n):
                counts += np.bincount(crc % buckets, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["bucket", "cnt"])

    return df.select(F.lower("text").alias("text")).mapInArrow(run, "bucket int, cnt long").groupBy("bucket").agg(F.sum("cnt").alias("cnt"))


def bucket_model(df: DataFrame, n: int = 2, buckets: int = 10_000, alpha: float = 1.0) -> DataFrame:
    """(bucket, logp) of all buckets, add-``alpha`` smoothed; ``buckets`` rows."""
    counts = bucket_counts(df, n, buckets)
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["cnt"])
    total = F.sum("cnt").over(Window.partitionBy(F.lit(0)))  # of ``buckets`` rows; a join would read the texts twice
    return every.select("bucket", F.log((F.col("cnt") + alpha) / (total + alpha * buckets)).alias("logp"))


@SCORERS.register("dsir")
class Dsir(Scorer):
    """Mean log ratio of a target's to the pool's n-gram model, with noise in proportion to the pool's spread."""

    def __init__(self, target: DataFrame, buckets: int = 10_000, ngram: int = 2, alpha: float = 1.0, gumbel_noise: bool = True, noise_ratio: float = 0.3, seed: int = 42) -> None:
        self.target, self.buckets, self.ngram, self.alpha = target, buckets, ngram, alpha
        self.noise_ratio, self.seed = noise_ratio if gumbel_noise else 0.0, seed
        self.ratios, self.scale = None, 0.0

    def fit(self, pool: DataFrame) -> Dsir:
        models = [bucket_model(d, self.ngram, self.buckets, self.alpha).withColumnRenamed("logp", k) for k, d in (("t", self.target), ("p", pool))]
        self.ratios = [r.ratio for r in models[0].join(models[1], "bucket").orderBy("bucket").select((F.col("t") - F.col("p")).alias("ratio")).collect()]  # one a bucket
        if self.noise_ratio:
            self.scale = self.noise_ratio * (self.weights(pool).agg(F.stddev_pop("weight")).first()[0] or 1.0)
        return self

    def weights(self, df: DataFrame) -> DataFrame:
        """``df`` with the mean ratio of its n-grams, looked up in a constant array; nothing is shuffled."""
        n, buckets, table = self.ngram, self.buckets, np.array(self.ratios)

        @F.arrow_udf("double")
        def mean(texts: pa.Array) -> pa.Array:
            out = [np.zeros(0)]
            for rows in cut([pa.RecordBatch.from_arrays([texts], ["text"])], "text", STRETCH):
                total = count = np.zeros(rows.num_rows)
                for sizes, crc in gram_crcs(*coded(rows["text"].combine_chunks()), n):
                    total, count = total + sums(table[crc % buckets], sizes), count + sizes
                out.append(total / np.maximum(count, 1))
            return pa.array(np.concatenate(out))

        return df.withColumn("weight", mean(F.lower("text")))

    def transform(self, df: DataFrame) -> DataFrame:
        score = F.col("weight")
        if self.noise_ratio:
            score = score + self.scale * gumbel(hash_uniform("dsir", self.seed, F.col("uid")))
        return self.weights(df).withColumn("score", score)


def centroid(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(i, c): the unit mean vector, one row a dimension; a vanishing mean is refused by a null."""
    mean = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.crossJoin(F.broadcast(norm)).select("i", F.when(F.col("norm") >= 1e-12, F.col("m") / F.col("norm")).alias("c"))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Unit mean of the token vectors whose mask is 1; without any, their sum over one token."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    size = F.size(F.get(vectors, F.lit(0)))
    total = F.transform(F.sequence(F.lit(0), size - 1), lambda d: F.aggregate(F.zip_with(vectors, mask, lambda v, m: F.get(v, d).cast("double") * m), F.lit(0.0), lambda s, x: s + x))
    unit = lambda v: let(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12))))
    return let(F.transform(total, lambda x: x / n), unit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@SCORERS.register("embed_similarity")
class EmbedSimilarity(Scorer):
    """Cosine of a record's vector with the centroid of target vectors."""

    def __init__(self, target: DataFrame, column: str = "embedding") -> None:
        self.target, self.column, self.center = target, column, None

    def fit(self, pool: DataFrame) -> EmbedSimilarity:
        unit = self.target.select(F.transform(self.column, lambda x: x / F.sqrt(dot(F.col(self.column), F.col(self.column)))).alias(self.column))
        self.center = [r.c for r in centroid(unit, self.column).orderBy("i").collect()]  # as many rows as dimensions
        if not self.center or None in self.center:
            raise ValueError("the target has no direction")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        v = F.col(self.column)
        return df.withColumn("score", dot(v, F.array(*map(F.lit, self.center))) / F.sqrt(dot(v, v)))


class NgramLM:
    """Bigram model interpolated half and half with the unigram model, both add-``alpha``; the reference model here."""

    def __init__(self, train: DataFrame, alpha: float = 0.1) -> None:
        self.train, self.index, self.alpha = train, bigrams.index(train), alpha  # one pass over the texts

    def nll(self, df: DataFrame) -> DataFrame:
        """(uid, nll, n): sum of token losses and number of tokens; the texts it was trained on are not read again."""
        rows = self.index if df is self.train else bigrams.index(df)
        return bigrams.losses(self.index, rows, self.alpha)


@SCORERS.register("perplexity")
class Perplexity(Scorer):
    """Mean token loss under a reference model: low, high or near the pool's median is best."""

    def __init__(self, model: NgramLM, mode: str = "mid") -> None:
        if mode not in ("low", "mid", "high"):
            raise ValueError(f"mode {mode!r} is not low, mid or high")
        self.model, self.mode, self.median = model, mode, None
        self.pool, self.losses = None, None

    def _losses(self, df: DataFrame) -> DataFrame:
        return self.model.nll(df).select("uid", (F.col("nll") / F.greatest(F.lit(1), F.col("n"))).alias("mean_nll"))

    def _mean(self, df: DataFrame) -> DataFrame:
        losses = self.losses if df is self.pool else self._losses(df)
        return df.join(losses, "uid", "left").fillna(0.0, ["mean_nll"])

    def fit(self, pool: DataFrame) -> Perplexity:
        if self.mode == "mid":
            self.pool, self.losses = pool, written(self._losses(pool), "losses")  # for the median and for the scores
            self.median = self._mean(pool).agg(F.median("mean_nll")).first()[0]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.col("mean_nll")
        score = {"low": -x, "high": x, "mid": -F.abs(x - F.lit(self.median))}[self.mode]
        return self._mean(df).withColumn("score", score)


def percentile_rank(value: Column, pos: Column, over: list[str] | None = None) -> Column:
    """Ordinal rank from 0 to 100; ties in pool order."""
    w = Window.partitionBy(*(over or [])).orderBy(value, pos)
    n = F.count(F.lit(1)).over(Window.partitionBy(*(over or [])))
    return 100.0 * (F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1))


#: Centers whose distances to all points are taken at a time, and points among which the next ones are sought.
CENTERS, NEAR = 64, 512


def kcenter_order(points: np.ndarray) -> list[int]:
    """Farthest-first order from the point nearest the mean; the first of equals.

    Gaps only fall, so the next centers are sought among the points of greatest gap until these are all below the others.
    Then all that are left meet the new centers at once: a matrix product tells, within its rounding error, which center
    is nearest, and only for those is the distance itself taken.
    """
    if not len(points):
        return []
    first = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order, gap = [first], ((points - points[first]) ** 2).sum(axis=1)
    left = np.delete(np.arange(len(points)), first)  # in order, so that the first of equals is found first
    rest, gap = points[left], gap[left]
    while len(left):
        most = min(NEAR, len(left))
        bound = -1.0 if most == len(left) else np.partition(gap, len(gap) - most - 1)[len(gap) - most - 1]
        if not gap.any():  # copies of centers, in order
            return order + left.tolist()
        near = np.flatnonzero(gap > bound)
        if equal := not len(near):  # more are equal and greatest than can be looked at; the first of them
            near = np.flatnonzero(gap == bound)[:most]
        x, g, new = rest[near], gap[near].copy(), []
        while len(new) < min(CENTERS, len(near)):
            best = int(g.argmax())
            if new and (g[best] < bound if equal else g[best] <= bound):
                break
            new.append(best)
            g = np.minimum(g, ((x - x[best]) ** 2).sum(axis=1))
            g[new] = -1.0
        order += left[near[new]].tolist()
        gap[near] = g
        keep = np.ones(len(left), bool)
        keep[near[new]] = False
        others = np.ones(len(left), bool)
        others[near] = False
        _lower(rest, gap, np.flatnonzero(others), x[new])
        left, rest, gap = left[keep], rest[keep], gap[keep]
    return order


def _lower(points: np.ndarray, gap: np.ndarray, which: np.ndarray, centers: np.ndarray) -> None:
    """Lower the gaps of the points ``which`` to their squared distance from the nearest of ``centers``, as ``kcenter_order`` takes it."""
    c = (centers**2).sum(axis=1)
    for at in range(0, len(which), 4096):
        rows = which[at : at + 4096]
        x = points[rows]
        s = (x**2).sum(axis=1)
        error = 1e-12 * (s[:, None] + c)
        least = s[:, None] + c - 2.0 * (x @ centers.T) - error
        i, j = np.nonzero((least < gap[rows][:, None]) & (least <= (least + 2.0 * error).min(axis=1)[:, None]))
        for k in range(0, len(i), 16384):
            u, v = i[k : k + 16384], j[k : k + 16384]
            np.minimum.at(gap, rows[u], ((x[u] - centers[v]) ** 2).sum(axis=1))


def kcenter(df: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """(pos, rank) by group in farthest-first order; for the survivors of a filter, whose number is the caller's to bound."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        vectors = table[column].combine_chunks()
        points = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).astype(float)
        order = pa.array(kcenter_order(points), pa.int64())
        return pa.table([table[group].take(order), table["pos"].take(order), pa.array(np.arange(len(order)), pa.int64())], names=[group, "pos", "rank"])

    kind = df.schema[group].dataType.simpleString()
    return df.select(group, F.col("pos").cast("long").alias("pos"), column).groupBy(group).applyInArrow(run, f"{group} {kind}, pos long, rank long")


@SCORERS.register("3ds")
class ThreeDifficulties(Scorer):
    """Instruction, response and gold difficulty: percentile ranks within bounds, nearest to the middle first.

    Needs columns d1, d2, d3, options, question, pos. Records that fail the quality filter or the bounds score minus
    infinity. With a column of vectors that all survivors have, the score is the number of survivors less the rank in
    farthest-first order; that order is taken in one task, so more than ``most`` survivors are refused then. Ranks are
    relative to the pool, so streams are refused.
    """

    streams = False

    def __init__(self, low: float = 25.0, high: float = 75.0, vectors: str | None = None, most: int = 20_000) -> None:
        self.low, self.high, self.vectors, self.most = low, high, vectors, most

    def ranks(self, df: DataFrame) -> DataFrame:
        good = df.where(good_question(F.col("options"), F.col("question"))).select("pos", "d1", "d2", "d3")
        last = F.lit(max(good.count() - 1, 1))
        for k in (1, 2, 3):
            good = ranked(good, F.asc(f"d{k}"), F.asc("pos")).withColumn(f"p{k}", 100.0 * (F.col("rank") - 1) / last).drop("rank")
        return df.join(good.drop("d1", "d2", "d3"), "pos", "left")

    def transform(self, df: DataFrame) -> DataFrame:
        if df.isStreaming:
            raise ValueError("3ds ranks within a pool and cannot stream")
        rows = self.ranks(df)
        inside = F.coalesce(F.col("p1").between(self.low, self.high) & F.col("p2").between(self.low, self.high) & F.col("p3").between(self.low, self.high), F.lit(False))
        off = sum((F.abs(F.col(f"p{k}") - 50.0) for k in (1, 2, 3)), F.lit(0.0))
        none = F.lit(float("-inf"))
        if self.vectors is not None:
            left = written(rows.where(inside).select(F.lit(0).alias("all"), "pos", self.vectors), "survivors")
            n, bare = left.agg(F.count(F.lit(1)), F.count_if(F.col(self.vectors).isNull())).first()
            if n and not bare:
                if n > self.most:
                    raise ValueError(f"{n} survivors are more than the {self.most} that are ordered farthest first")
                order = kcenter(left, "all", self.vectors).select("pos", (n - F.col("rank")).cast("double").alias("_order"))
                return rows.join(F.broadcast(order), "pos", "left").withColumn("score", F.coalesce("_order", none)).drop("_order")
        return rows.withColumn("score", F.when(inside, -off).otherwise(none))


class LogisticProxy:
    """Logistic model over hashed words: the stand-in for a neural proxy, with closed-form gradients.

    Its features are shares of ``dims`` word buckets and a one; it is trained on at most ``sample`` rows of lowest hash.
    """

    def __init__(self, dims: int = 32, sample: int = 4000) -> None:
        self.dims, self.sample = dims, sample

    def features(self, text: Column) -> Column:
        def shares(grams: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda d: F.size(F.filter(grams, lambda g: g == d)) / F.greatest(F.lit(1), F.size(grams)))

        return F.concat(let(ngram_buckets(normal_words(text), 1, self.dims), shares), F.array(F.lit(1.0)))

    def matrix(self, df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = df.where("y is not null").select(F.md5("uid").alias("_h"), "text", "y").orderBy("_h").limit(self.sample)
        rows = rows.select("_h", self.features(F.col("text")).alias("x"), "y").orderBy("_h").collect()
        return np.array([r.x for r in rows]).reshape(len(rows), self.dims + 1), np.array([r.y for r in rows], float)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def adam_direction(g: np.ndarray, m: np.ndarray, v: np.ndarray, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> np.ndarray:
    """Moments updated by ``g`` and their quotient, without bias correction."""
    return (b1 * m + (1 - b1) * g) / (np.sqrt(b2 * v + (1 - b2) * g * g) + eps)


def project(g: np.ndarray, dims: int, seed: int = 42) -> np.ndarray:
    """``dims`` coordinates chosen by ``seed``, scaled to keep the expected norm."""
    at = np.random.default_rng(seed).permutation(g.shape[-1])[:dims]
    return g[..., at] / np.sqrt(len(at) / g.shape[-1])


def _logit(x: Column, theta: np.ndarray) -> Column:
    return dot(x, F.array(*map(F.lit, theta.tolist())))


def _loss_slope(x: Column, theta: np.ndarray) -> Column:
    return 1 / (1 + F.exp(-_logit(x, theta))) - F.col("y")


@SCORERS.register("less")
class Less(Scorer):
    """Mean over epochs of the cosine between a record's projected Adam direction and the target's mean gradient.

    Rows need text, uid and y (0, 1 or null); those without y score minus infinity.
    """

    def __init__(self, target: DataFrame, epochs: int = 4, rate: float = 0.5, dims: int = 16, proxy: LogisticProxy | None = None) -> None:
        self.target, self.epochs, self.rate, self.dims, self.proxy = target, epochs, rate, dims, proxy or LogisticProxy()
        self.states: list[tuple] = []

    def fit(self, pool: DataFrame) -> Less:
        x, y = self.proxy.matrix(pool)
        tx, ty = self.proxy.matrix(self.target)
        theta, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for _ in range(self.epochs):
            g = ((_sigmoid(x @ theta) - y)[:, None] * x).mean(axis=0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - self.rate * m / (np.sqrt(v) + 1e-8)
            t = project(((_sigmoid(tx @ theta) - ty)[:, None] * tx).mean(axis=0), self.dims)
            self.states.append((theta, m, v, t / max(float(np.linalg.norm(t)), 1e-12)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("_x", self.proxy.features(F.col("text")))
        states, dims = self.states, self.dims

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if pdf.empty:
                    continue
                a, b = np.stack(pdf["_x"].to_numpy()), pdf["y"].to_numpy(dtype=float)
                out = np.zeros(len(b))
                for theta, m, v, t in states:
                    g = project(adam_direction((_sigmoid(a @ theta) - b)[:, None] * a, m, v), dims)
                    out += (g @ t) / np.maximum(np.linalg.norm(g, axis=1), 1e-12)
                yield pdf.drop(columns="_x").assign(score=np.where(np.isnan(b), -np.inf, out / len(states)))

        return rows.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


@SCORERS.register("pds")
class Pds(Scorer):
    """Accumulated product of a record's gradient with the costate of proxy training, solved forward and backward.

    The proxy is trained on a bounded sample; all records are scored with column expressions. Those without y score
    minus infinity. Noise, if asked for, is in proportion to the sample standard deviation of the scores.
    """

    def __init__(self, target: DataFrame, steps: int = 20, rate: float = 0.5, interval: int = 5, noise_ratio: float = 0.0, seed: int = 42, proxy: LogisticProxy | None = None) -> None:
        self.target, self.steps, self.rate, self.interval = target, steps, rate, interval
        self.noise_ratio, self.seed, self.proxy, self.pairs = noise_ratio, seed, proxy or LogisticProxy(), []

    def fit(self, pool: DataFrame) -> Pds:
        x, y = self.proxy.matrix(pool)
        tx, ty = self.proxy.matrix(self.target)
        grad = lambda a, b, th: ((_sigmoid(a @ th) - b)[:, None] * a).mean(axis=0)
        thetas = [np.zeros(x.shape[1])]
        for _ in range(self.steps):
            thetas.append(thetas[-1] - self.rate * grad(x, y, thetas[-1]))
        costate = np.zeros(x.shape[1])
        for t in range(self.steps, 0, -1):
            costate = costate + grad(tx, ty, thetas[t])
            if t % self.interval == 0:
                self.pairs.append((thetas[t], costate.copy()))
            s = _sigmoid(x @ thetas[t])
            costate = costate - self.rate * (x * (s * (1 - s) * (x @ costate))[:, None]).mean(axis=0)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("_x", self.proxy.features(F.col("text")))
        score = sum((_loss_slope(F.col("_x"), theta) * _logit(F.col("_x"), lam) for theta, lam in self.pairs), F.lit(0.0))
        rows = rows.withColumn("score", F.when(F.col("y").isNull(), F.lit(float("-inf"))).otherwise(score)).drop("_x")
        if self.noise_ratio:
            spread = rows.where("y is not null").agg(F.stddev_samp("score")).first()[0] or 1.0
            rows = rows.withColumn("score", F.col("score") + self.noise_ratio * spread * gumbel(hash_uniform("pds", self.seed, F.col("uid"))))
        return rows
