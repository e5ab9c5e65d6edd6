"""Mixing sources to target weights by soft membership (operator 6).

A multinomial logistic classifier over hashed words is trained on labelled rows (a bounded sample: ``train_rows``
rows in hash order) and predicts, for every document, posteriors over the domains of the label table.  With
``a[d, k] = tokens(d) * posterior(d, k)``, rates ``r`` are fitted so that the expected tokens per domain
``sum_d r[d] a[d, k]`` match the targets (shares of all tokens) in least squares, with the least relative change of rates,
``sum_d tokens(d) (r[d] - 1)^2``, as the tie-break.  A rate is at least 0, and at least 1 for a document whose likeliest
domain is ``high``: clean documents are repeated, never left out.  The best rates have the form ``max(least, 1 - posterior . g)``
with one vector ``g`` of as many numbers as there are domains, so a document's length does not decide its rate; ``g`` is
found by scaled projected gradient steps on the driver, each one distributed aggregation that rebuilds the rates from
``g``.  Targets out of reach are met as nearly as the bounds let them; ``residuals`` tells what is missed.

Defined cases: null labels are ignored, of several labels of a document the largest counts; a null or empty
text has 0 tokens, equal posteriors and rate 1; without usable labels there is one domain and all rates are 1;
a target for a domain without tokens stays unmet; repeated rows each get a rate; an empty table gives an empty
table; other columns are passed through by ``apply_rates`` and ignored by ``fit_rates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bytescan as bs
from lectern.llm.common import documents, lean, small_batches, stored, unused

FEATURES = 1 << 15
#: The bound of the labelled sample that trains the classifier.
TRAIN_ROWS = 6000
STEPS = 25
_LIST = pa.list_(pa.int64())


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.empty((len(counts), len(self.domains)))
        for i, (f, v) in enumerate(counts):
            z = v @ self.weights[f] + self.bias if len(f) else np.zeros(len(self.domains))
            e = np.exp(z - z.max())
            out[i] = e / e.sum()
        return out


def features(s: bs.Slice) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hashed words of each document with normalised weights, and its number of words."""
    starts, ends, doc, data = bs.words(s, bs.ALNUM, lower=True)
    slot = (bs.word_hashes(data, starts, ends) % np.uint64(FEATURES)).astype(np.int64)
    key, count = np.unique(doc * FEATURES + slot, return_counts=True)
    cuts = np.searchsorted(key, np.arange(s.n + 1) * FEATURES)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        v = np.log1p(count[a:b])
        out.append((key[a:b] % FEATURES, v / (np.sqrt((v * v).sum()) or 1.0)))
    return out, np.bincount(doc, minlength=s.n)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], steps: int = 150, rate: float = 1.0, decay: float = 1e-4) -> Classifier:
    """Full-batch multinomial logistic regression with Adagrad steps."""
    domains = sorted({d for d, _, _ in rows}) or ["all"]
    k = len(domains)
    w, b = np.zeros((FEATURES, k)), np.zeros(k)
    if k > 1:
        f = np.concatenate([x for _, x, _ in rows])
        v = np.concatenate([x for _, _, x in rows])
        row = np.repeat(np.arange(len(rows)), [len(x) for _, x, _ in rows])
        used, col = np.unique(f, return_inverse=True)
        y = np.zeros((len(rows), k))
        y[np.arange(len(rows)), [domains.index(d) for d, _, _ in rows]] = 1
        wu, gw, gb = np.zeros((len(used), k)), np.full((len(used), k), 1e-8), np.full(k, 1e-8)
        for _ in range(steps):
            z = np.stack([np.bincount(row, weights=v * wu[col, j], minlength=len(rows)) for j in range(k)], axis=1) + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            e = (p / p.sum(axis=1, keepdims=True) - y) / len(rows)
            g = np.stack([np.bincount(col, weights=v * e[row, j], minlength=len(used)) for j in range(k)], axis=1) + decay * wu
            gw += g * g
            gb += e.sum(axis=0) ** 2
            wu -= rate * g / np.sqrt(gw)
            b -= rate * e.sum(axis=0) / np.sqrt(gb)
        w[used] = wu
    return Classifier(domains, w.astype(np.float32), b)


def labelled(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Domain of each labelled document: toxic, high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    rows = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return rows.select(F.col(id_col).alias("_id"), domain.alias("_domain")).where("_domain is not null")


def fit_classifier(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    chosen = labelled(labels, id_col).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    # At most ``train_rows`` identifiers, so the broadcast is bounded.
    texts = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"))
    sample = texts.join(F.broadcast(chosen), F.col("_own") == F.col("_id")).groupBy("_id", "_domain").agg(F.min("_text").alias("_t"))
    ids = labels.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in bs.slices(b.column(2)):
                fv, _ = features(s)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n), b.column(1).slice(s.first, s.n), pa.array([f.astype(np.int32).tobytes() for f, _ in fv], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in fv], pa.binary())], names=["id", "domain", "f", "v"])

    got = sample.select("_id", "_domain", "_t").mapInArrow(lean(run), f"id {ids}, domain string, f binary, v binary").collect()
    rows = sorted(((r["id"], r["domain"], np.frombuffer(r["f"], np.int32), np.frombuffer(r["v"], np.float32)) for r in got), key=lambda r: r[0])
    return train([r[1:] for r in rows if len(r[2])])


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, n_tokens, p`` (an array, one posterior per domain) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in bs.slices(b.column(2)):
                fv, n = features(s)
                p = shared.value.posteriors(fv)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n), b.column(1).slice(s.first, s.n), pa.array(n.astype(np.int64)), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["id", "text_hash", "n_tokens", "p"])

    ids = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.xxhash64(text_col), text_col).mapInArrow(lean(run), f"id {ids}, text_hash bigint, n_tokens bigint, p array<double>")


#: Documents whose likeliest domain is this one keep a rate of 1 at least.
CLEAN = "high"


def _rate(g: np.ndarray, domains: list[str]) -> Column:
    """Rates by the vector ``g``; a row without tokens has rate 1."""
    p = [F.col("p")[j] for j in range(len(domains))]
    return F.when(F.col("n_tokens") == 0, F.lit(1.0)).otherwise(F.greatest(_least(domains), _free(g, p)))


def _free(g: np.ndarray, p: list[Column]) -> Column:
    return F.lit(1.0) - sum((x * float(y) for x, y in zip(p[1:], g[1:], strict=True)), p[0] * float(g[0]))


def _least(domains: list[str]) -> Column:
    if CLEAN not in domains:
        return F.lit(0.0)
    return F.when(F.col("p")[domains.index(CLEAN)] >= F.array_max("p"), F.lit(1.0)).otherwise(F.lit(0.0))


#: Weight of the rates' change beside the squared misses: small, so that targets within reach are met, and all others have one best fit.
RIDGE = 1e-4


def _fit_vector(table: DataFrame, domains: list[str], want: np.ndarray, total: int, steps: int) -> np.ndarray:
    """The vector of the rates with the least squared misses of ``want`` (shares of ``total`` tokens) plus ``RIDGE`` times the squared change.

    That optimum has the form ``rate = max(least, 1 - p . g)`` with ``RIDGE * g`` the misses, so ``g`` solves a concave
    problem in as many numbers as there are domains; projected gradient steps on it are scaled by the rows that are not at
    their bound and halved until they gain.
    """
    k = len(domains)
    p = [F.col("p")[j] for j in range(k)]
    w = F.col("n_tokens") / F.lit(float(total))

    def at(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and the Gram matrix of the rows that can move: one aggregation."""
        moves, r = _free(g, p) > _least(domains), _rate(g, domains)
        sums = [F.sum(r * w * x) for x in p] + [F.sum((r - 1) * (r - 1) * w)] + [F.sum(F.when(moves, w * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(k)]
        got = np.array(table.agg(*sums).first(), dtype=float)
        miss = got[:k] - want
        return got[k] / 2 + g @ miss - RIDGE * (g @ g) / 2, miss - RIDGE * g, got[k + 1 :].reshape(k, k)

    g, pace = np.zeros(k), 1.0
    value, slope, gram = at(g)
    for _ in range(steps):
        if np.abs(slope).max() <= 1e-5:
            break
        step = np.linalg.solve(gram + RIDGE * np.eye(k), slope)
        new = g + pace * step
        found = at(new)
        if found[0] > value:
            g, (value, slope, gram), pace = new, found, min(1.0, 2 * pace)
        else:
            pace /= 2
    return g


def _fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], train_rows: int, steps: int, id_col: str, text_col: str) -> tuple[DataFrame, Classifier, np.ndarray]:
    """The posterior table, the classifier and the vector of the rates."""
    small_batches(docs.sparkSession)
    model = fit_classifier(docs, labels, train_rows, id_col, text_col)
    table = stored(posteriors(docs, model, id_col, text_col), "posteriors")
    k = len(model.domains)
    total = table.agg(F.sum("n_tokens")).first()[0]
    want = np.array([targets.get(d, 0.0) for d in model.domains])
    if k == 1 or not total or not want.sum():
        return table, model, np.zeros(k)
    return table, model, _fit_vector(table, model.domains, want / want.sum(), total, steps)


def fit_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], train_rows: int = TRAIN_ROWS, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Classifier]:
    """``id, text_hash, n_tokens, p, rate`` of every row; targets are shares of all tokens by domain."""
    table, model, g = _fit(docs, labels, targets, train_rows, steps, id_col, text_col)
    return table.withColumn("rate", _rate(g, model.domains)), model


def residuals(rates: DataFrame, domains: list[str], targets: dict[str, float]) -> DataFrame:
    """``domain, target, share, residual``: the share of tokens each domain has under fitted ``rates``, and what it misses."""
    whole = sum(targets.get(d, 0.0) for d in domains) or 1.0
    tokens = F.col("rate") * F.col("n_tokens")
    sums = rates.agg(F.sum(tokens).alias("all"), *(F.sum(tokens * F.col("p")[j]).alias(f"s{j}") for j in range(len(domains))))
    rows = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(targets.get(d, 0.0) / whole).alias("target"), (F.col(f"s{j}") / F.col("all")).alias("share")) for j, d in enumerate(domains)))
    return sums.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.share") - F.col("r.target")).alias("residual"))


def _uniform(*key: str | Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 24)) / F.lit(float(1 << 24))


def copies(rate: Column, *key: str | Column) -> Column:
    """Whole copies of a row: the rate rounded at random, by a hash of the row, so that its expectation stays."""
    return F.floor(rate + _uniform(*key)).cast("int")


#: Shares of tokens that a training mix should have; what the classifier takes for toxic or low is held down.
TARGETS = {"high": 0.85, "low": 0.09, "toxic": 0.06}


def apply_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, each as often as its rate says; posteriors and rate are computed again in place, without a join."""
    _, model, g = _fit(docs, labels, targets, TRAIN_ROWS, STEPS, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model, g))
    at, width = docs.columns.index(text_col), len(docs.columns)
    keyed = docs.withColumn(unused("_u", docs), _uniform(id_col, F.xxhash64(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, g = shared.value
        for b in batches:
            for s in bs.slices(b.column(at)):
                fv, n = features(s)
                p = model.posteriors(fv)
                least = p[:, model.domains.index(CLEAN)] >= p.max(axis=1) if CLEAN in model.domains else np.zeros(s.n)
                r = np.where(n == 0, 1.0, np.maximum(least, 1.0 - p @ g))
                times = np.floor(r + np.asarray(b.column(width).slice(s.first, s.n))).astype(np.int64)
                yield b.slice(s.first, s.n).select(range(width)).take(pa.array(np.repeat(np.arange(s.n), times)))

    return keyed.mapInArrow(lean(run), docs.schema)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, model = fit_rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS)
    p = [F.round(F.col("p")[j], 6).alias(f"p_{d}") for j, d in enumerate(model.domains)]
    return table.select(F.col("id").alias("doc_id"), "n_tokens", *p, F.round("rate", 6).alias("rate"), copies(F.col("rate"), "id", "text_hash").alias("copies"))
