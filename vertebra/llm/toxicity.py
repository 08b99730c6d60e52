"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all training documents, labels
unseen, is the unlabelled set.  A linear classifier over word presence minimises
prior * loss(positives as toxic) + max(0, loss(unlabelled as clean) - prior * loss(positives
as clean)): the class prior corrects for the toxic documents among the unlabelled, and a
negative second part is walked back instead of followed.  Several classifiers, each on a
bag of the unlabelled sample, are trained in parallel tasks and averaged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heaviest, held, in_fold, pieces, stash

#: Bounds of the training sample (rows) and of the vocabulary (words).
POSITIVES, UNLABELLED, WORDS = 6000, 20000, 20000
#: A feature is a word that at least LEAST_DF positives have, and that is LIFT times as
#: frequent in positives as in unlabelled texts, both taken SURE standard errors to the
#: unfavourable side.  The logarithm of that lift is the feature's value.
LEAST_DF, LIFT, SURE = 3, 1.5, 2.0
BAGS = 4
#: Sum of a positive's feature values (on average) from which on they are scaled down.
LARGEST = 100.0
THRESHOLD = 0.3

_TOKEN = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    """Distinct lower-cased words; words over 40 letters are no features."""
    return {w for w in _TOKEN.findall((text or "").lower()) if len(w) <= 40}


def train_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], value_of: np.ndarray, prior: float,
               steps: int = 300, rate: float = 0.1, l1: float = 1e-4) -> np.ndarray:
    """Weights per word (the last is the bias) of the risk's minimum, by Adam with soft
    thresholds.  ``pos``, ``unl``: word numbers of each document; ``value_of``: the words'
    feature values, scaled down where the positives hold so many that one step would
    overshoot."""
    n_words = len(value_of)
    value_of = value_of / max(1.0, float(np.mean([value_of[r].sum() for r in pos])) / LARGEST)

    def sparse(rows):
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        return np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), len(rows)

    def value(x, w):
        return np.bincount(x[0], weights=(w[:-1] * value_of)[x[1]], minlength=x[2]) + w[-1]

    def grad(x, g):
        return np.append(np.bincount(x[1], weights=g[x[0]], minlength=n_words) * value_of, g.sum())

    loss = lambda z: np.logaddexp(0.0, -z)
    slope = lambda z: -1.0 / (1.0 + np.exp(np.clip(z, -50, 50)))
    p, u = sparse(pos), sparse(unl)
    w = np.zeros(n_words + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        fp, fu = value(p, w), value(u, w)
        clean = loss(-fu).mean() - prior * loss(-fp).mean()
        g = grad(u, -slope(-fu) / u[2]) + grad(p, prior * slope(-fp) / p[2])
        # a negative risk of the clean class is overfitting: step back from it
        g = -g if clean < 0 else g + grad(p, prior * slope(fp) / p[2])
        m = 0.9 * m + 0.1 * g
        s = 0.999 * s + 0.001 * g * g
        lr = rate / (1 + 3 * t / steps)
        denominator = np.sqrt(s / (1 - 0.999 ** t)) + 1e-5
        w = w - lr * (m / (1 - 0.9 ** t)) / denominator
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - lr * l1 / denominator[:-1], 0)
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cutoff(value(p, w), value(u, w), prior)
    return np.append(w[:-1] * value_of, w[-1])


def cutoff(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The cut of the best F1 that positives and unlabelled values can estimate: recall is
    the share of positives above, and prior * recall over the share of all above is the
    precision.  It lies midway between the values above and below it."""
    cuts, fu = np.unique(fp), np.sort(fu)
    recall = 1 - np.searchsorted(np.sort(fp), cuts) / len(fp)
    above = np.maximum(1 - np.searchsorted(fu, cuts) / len(fu), prior * recall)
    best = cuts[np.argmax(2 * prior * recall / (prior + above))]
    below = np.concatenate([fu[fu < best], cuts[cuts < best]])
    return float((best + below.max()) / 2) if len(below) else float(best)


class Model:
    """Vocabulary and weights; ``vocabulary`` is empty if there was nothing to learn from."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(sorted(get(w, 0.0) for w in words(text) if w in self.weights))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(c)) for c in ("pos", "bag")]
            + [pa.array([sorted(words(t)) for t in texts], pa.list_(pa.string()))], names=["pos", "bag", "words"])


def fit(docs: DataFrame, labels: DataFrame, train=None) -> Model:
    """Train on the rows of ``docs`` (doc_id, text) that ``train`` (a Column) holds for.

    ``labels`` (doc_id, toxic): 1 confirms a positive, 0 only enters the class prior; null
    or missing labels leave a row unlabelled.  At most POSITIVES positives and UNLABELLED
    others (expected counts, chosen by a hash of doc_id and text) are used.  Without a
    positive, or with nothing else, the model scores every text alike, by the prior.
    """
    train = F.lit(True) if train is None else train
    rows = docs.select("doc_id", "text").where(train & F.col("text").isNotNull())
    known = (labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # the join sees ids and draws only; of the texts, those of the bounded sample are fetched afterwards
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
    marked = stash(rows.select("doc_id", "draw").join(known, "doc_id"), "toxic-known")
    got = {r["toxic"]: r["n"] for r in marked.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_all = got.get(1, 0), rows.count()
    if not n_pos or n_all < 2:
        return Model({}, -30.0)
    prior = min(max(n_pos / (n_pos + got.get(0, 0)), 0.01), 0.5) if got.get(0, 0) else 0.1
    some = lambda df, bound, n: df.where(F.col("draw") / float(1 << 30) < min(1.0, bound / n))
    # words that tell nothing apart are no reason to call any text toxic
    nothing_found = min(float(np.log(prior / (1 - prior))), float(np.log(THRESHOLD / (1 - THRESHOLD))) - 1.0)
    # at most about POSITIVES pairs of numbers, whatever the table's size, so they are broadcast
    picked = some(marked.where("toxic > 0"), POSITIVES, n_pos).select("doc_id", "draw").distinct()
    sample = rows.join(F.broadcast(picked), ["doc_id", "draw"], "left_semi").select("text", F.lit(True).alias("pos"), F.lit(-1).alias("bag"))
    sample = sample.unionByName(some(rows, UNLABELLED, n_all).select(
        "text", F.lit(False).alias("pos"), F.pmod(F.xxhash64("text", F.lit(5)), F.lit(BAGS)).cast("int").alias("bag")))
    seen = stash(sample.mapInArrow(_distinct_words, "pos boolean, bag int, words array<string>"), "toxic-sample")
    p_n, u_n = (max(seen.where(x).count(), 1) for x in ("pos", "NOT pos"))
    p, u = F.col("p") / p_n, (F.col("u") + 0.5) / u_n
    lift = F.log((p - SURE * F.sqrt(p * (1 - p) / p_n)) / (u + SURE * F.sqrt(u * F.greatest(1 - u, F.lit(0.0)) / u_n)))
    lifted = (seen.select("pos", F.explode("words").alias("w")).groupBy("w")
              .agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("u")).where(F.col("p") >= LEAST_DF)
              .select("w", "p", lift.alias("lift")).where(F.col("lift") >= float(np.log(LIFT))))
    top = sorted(heaviest(lifted, "p", WORDS, "w").collect(), key=lambda r: (-r["p"], r["w"]))
    vocabulary, values = [r["w"] for r in top], np.array([r["lift"] for r in top])
    if not vocabulary:
        return Model({}, nothing_found)
    number = {w: i for i, w in enumerate(vocabulary)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("words"))
            ids = pc.index_in(lists.flatten(), value_set=known)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(False))
            there = ids.is_valid().to_numpy(False)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[there], minlength=len(lists)))])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in ("pos", "bag")],
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.drop_null().cast(pa.int32()))], names=["pos", "bag", "ids"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.asarray(ids, dtype=np.int64) for ids in pdf["ids"]]
        is_pos = pdf["pos"].to_numpy(bool)
        pos, unl = ([rows[i] for i in np.nonzero(x)[0]] for x in (is_pos, ~is_pos))
        if not pos or not unl:
            return pd.DataFrame({"bag": [], "w": []})
        w = train_nnpu(pos, unl, values, prior)
        mean = lambda docs: float(np.mean([w[d].sum() for d in docs]))
        if not mean(pos) > mean(unl):  # it tells them apart the wrong way round: nothing was learned
            return pd.DataFrame({"bag": [], "w": []})
        return pd.DataFrame({"bag": [int(pdf["bag"].iloc[0])], "w": [w]})

    known = seen.mapInArrow(numbered, "pos boolean, bag int, ids array<int>")  # only the vocabulary goes on
    bags = known.where("NOT pos").unionByName(
        known.where("pos").withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(BAGS - 1)))))
    weights = [np.array(r["w"]) for r in bags.groupBy("bag").applyInPandas(learn, "bag int, w array<double>").orderBy("bag").collect()]
    if not weights:
        return Model({}, nothing_found)
    mean = np.mean(weights, axis=0)
    return Model({w: float(mean[i]) for w, i in number.items() if mean[i]}, float(mean[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but score, and score (0 to 1).  A null or empty text gets the
    score of a text without known words; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]
    docs = docs.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity")  # nothing, but what other stages kept goes
        m = shared.value
        for batch, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.score(t) for t in texts], pa.float64())],
                                             names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = in_fold(F.col("doc_id"), 4, 2)
    model = fit(docs, labels, ~held)
    return score(docs.select("doc_id", "text", held.alias("held_out")), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
