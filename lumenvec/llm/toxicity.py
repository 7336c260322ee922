"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive sample; the unlabelled sample is texts
whose label is not looked at. With the class prior p, the risk of a score f is

    p * E_pos[loss(f, +)] + max(0, E_unl[loss(f, -)] - p * E_pos[loss(f, -)])

with the logistic loss. Where the second part falls below zero the model has
begun to learn the positives by heart, and the step goes up that part instead.
The model is linear in numpy: its features are words and beginnings of words,
counted by the different words of a text that have them, and the text's length.

What is fitted is bounded: at most ``max_positive`` and ``max_unlabelled``
texts, chosen by hash among the labelled rows, and at most ``max_features``
features, counted in Spark over these texts and chosen by how much commoner
they are in positives. Rows with one doc_id count as one text, the one with
the smallest hash. Every row of the corpus is then scored where it lies,
whole. Memory in a worker: the features and a bounded cache of words.

Defined results: null and empty texts have no features and a score of their
own; without confirmed positives every score is the prior; a null doc_id is
not held out and has no label; labels that are null are no labels; of several
labels for a doc_id the largest counts; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.plans.strategy import materialize
from lumenvec.session import ship_package

EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…¡¿"
WORD_CACHE = 1 << 19


@dataclass(frozen=True)
class Fit:
    max_positive: int = 4000
    max_unlabelled: int = 8000
    max_features: int = 2000
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)
    least_positive: int = 3
    steps: int = 800
    rate: float = 0.05
    decay: float = 0.0002
    seed: int = 11


@dataclass(frozen=True)
class Model:
    features: dict[str, int]
    weights: "object"
    bias: float
    by_length: float
    prior: float
    prefixes: tuple[int, ...]


def held_out(key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(k.cast("string")) % 4 == 2, F.lit(False))


def word_features(word: str, prefixes: tuple[int, ...]) -> list[str]:
    return [word, *[word[:k] + "*" for k in prefixes if k < len(word)]]


def distinct_words(text: str | None) -> set[str]:
    found = {w.strip(EDGES) for w in set((text or "").lower().split())}
    found.discard("")
    return found


def sample(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), text: str = "text", key: str = "doc_id") -> tuple[DataFrame, float]:
    """(positive, text): the confirmed positives and the unlabelled texts, and the class prior."""
    own = F.col(f"`{key}`")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out("doc_id"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    shuffled = F.xxhash64(F.lit(fit.seed), "doc_id")
    positive = known.where("toxic = 1").orderBy(shuffled).limit(fit.max_positive).select(F.col("doc_id").alias("id"), F.lit(True).alias("positive"))
    hidden = known.orderBy(shuffled).limit(fit.max_unlabelled).select(F.col("doc_id").alias("id"), F.lit(False).alias("positive"))
    # At most max_positive + max_unlabelled ids, and one text of each: the one with the smallest hash.
    chosen = F.broadcast(positive.unionByName(hidden))
    rows = docs.select(own.alias("id"), F.col(f"`{text}`").alias("text")).join(chosen, "id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")
    return materialize(rows.groupBy("id", "positive").agg(one).select("positive", "x.text"), "toxicity-sample"), prior or 0.0


def choose_features(rows: DataFrame, fit: Fit = Fit()) -> list[str]:
    """The features that are commoner in positives, most telling first."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        for b in batches:
            counts = (Counter(), Counter())
            for positive, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[positive].update({f for w in distinct_words(t) for f in word_features(w, fit.prefixes)})
            own = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict(
                {"feature": pa.array(own, pa.string()), "p": pa.array([counts[1][x] for x in own], pa.int64()),
                 "u": pa.array([counts[0][x] for x in own], pa.int64())}
            )

    n = rows.groupBy().agg(F.sum(F.col("positive").cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    n_p, n_u = n["p"] or 0, n["n"] - (n["p"] or 0)
    if not n_p or not n_u:
        return []
    by = rows.mapInArrow(run, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate_p, rate_u = F.col("p") / F.lit(float(n_p)), (F.col("u") + 1) / F.lit(float(n_u))
    # Twice as common in positives as in all texts; many texts, or a large ratio, first.
    told = by.where(F.col("p") >= fit.least_positive).withColumn("lift", rate_p / rate_u).where("lift > 2")
    best = told.orderBy((F.sqrt("p") * F.log("lift")).desc(), "feature").limit(fit.max_features)
    return [r["feature"] for r in best.select("feature").collect()]


class Reader(dict):
    """The features of a raw word, from the chosen ones."""

    def __init__(self, features: dict[str, int], prefixes: tuple[int, ...]) -> None:
        super().__init__()
        self.features, self.prefixes = features, prefixes

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORD_CACHE:
            self.clear()
        found = tuple(self.features[f] for f in word_features(word, self.prefixes) if f in self.features)
        self[word] = found
        return found

    def row(self, text: str | None) -> tuple[list[int], list[float], float]:
        """(features, log(1 + words that have it), log(1 + different words))."""
        from collections import Counter
        from math import log1p

        words = distinct_words(text)
        counts: Counter = Counter()
        for w in words:
            if found := self[w]:
                counts.update(found)
        return list(counts), [log1p(n) for n in counts.values()], log1p(len(words))


def risk_step(theta, row, flat, value, long, pos, prior: float):
    """(the direction that a step goes against, the risk's second part): the slope of the
    whole risk, or where its second part is below zero the slope of that part turned round.

    ``row``, ``flat``, ``value``: the features of all texts in a row; ``long``: their lengths."""
    import numpy as np

    z = np.bincount(row, value * theta[flat], len(long)) + theta[-2] + theta[-1] * long
    as_negative = np.logaddexp(0, z)  # the loss of calling it negative
    rest = as_negative[~pos].mean() - prior * as_negative[pos].mean()
    g, slope = np.zeros(len(long)), 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    if rest >= 0:
        g[pos] += prior * (slope[pos] - 1) / pos.sum()
        g[pos] -= prior * slope[pos] / pos.sum()
        g[~pos] += slope[~pos] / (~pos).sum()
    else:
        g[pos] += prior * slope[pos] / pos.sum()
        g[~pos] -= slope[~pos] / (~pos).sum()
    return np.concatenate((np.bincount(flat, value * g[row], len(theta) - 2), [g.sum(), (g * long).sum()])), rest


def fit_nnpu(indices: list, values: list, lengths, positive, n_features: int, prior: float, fit: Fit = Fit()):
    """(weights, bias, weight of the length) that make the non-negative risk small."""
    import numpy as np

    sizes = np.array([len(x) for x in indices])
    row = np.repeat(np.arange(len(indices)), sizes)
    flat = np.concatenate([np.asarray(x, np.int64) for x in indices]) if len(indices) else np.zeros(0, np.int64)
    value = np.concatenate([np.asarray(x, float) for x in values]) if len(values) else np.zeros(0)
    long = np.asarray(lengths, float)
    pos = np.asarray(positive, bool)
    theta = np.zeros(n_features + 2)
    theta[-2] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, fit.steps + 1):
        grad, _ = risk_step(theta, row, flat, value, long, pos, prior)
        grad[:-2] += fit.decay * theta[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= fit.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), text: str = "text", key: str = "doc_id") -> Model:
    """The model; at most max_positive + max_unlabelled sparse rows reach the driver."""
    ship_package(docs.sparkSession)
    rows, prior = sample(docs, labels, fit, text, key)
    features = {f: i for i, f in enumerate(choose_features(rows, fit))}
    if not features or not 0 < prior < 1:
        return Model({}, [], 0.0, 0.0, prior, fit.prefixes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = Reader(features, fit.prefixes)
        for b in batches:
            found = [reader.row(t) for t in b.column(1).to_pylist()]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64())
            columns = [pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * 3, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["positive", "indices", "values", "length"])

    got = rows.mapInArrow(run, "positive boolean, indices array<int>, values array<double>, length double").toPandas()
    weights, bias, by_length = fit_nnpu(
        got["indices"].tolist(), got["values"].tolist(), got["length"], got["positive"], len(features), prior, fit
    )
    return Model(features, weights, bias, by_length, prior, fit.prefixes)


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score) for every row."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        from math import exp

        import pyarrow as pa

        reader = Reader(model.features, model.prefixes)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                if not model.features:
                    out.append(model.prior)
                    continue
                indices, values, length = reader.row(t)
                z = model.bias + model.by_length * length + sum(model.weights[i] * x for i, x in zip(indices, values))
                out.append(1 / (1 + exp(-max(-40.0, min(40.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    lean = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return lean.mapInArrow(run, f"doc_id {kind}, score double")
