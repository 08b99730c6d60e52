"""Scoring texts with a hidden Markov language model.

A word is emitted in two steps: the state emits a word class, the class its word.  The
commonest words are classes of their own; the others share classes by their last letters.
Classes are bounded in number, so the model is small however large the vocabulary, while
the words' counts stay a table that is joined.

Baum-Welch runs over all training documents: each task adds up its expected counts by the
scaled forward and backward recursions, and Spark sums them.  Expected counts are summed
as integers, so the model does not depend on the order of tasks.  Scoring runs the scaled
forward recursion over the whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heaviest, in_fold, pieces, stash

STATES, ROUNDS, SEED = 8, 4, 11
#: Words with a class of their own, and classes for all other words.
HEAD, TAIL = 6000, 1024
#: Commonest words whose counts go along to every task; other words' counts are joined.
KNOWN = 60_000
#: Training runs over stretches of so many tokens; every token is in one of them.
STRETCH = 256
#: The token that ends every text: no word holds white space.
END = b"\n"
_UNIT = float(1 << 16)


def tail_class(word: bytes) -> int:
    """Class of a word that has none of its own."""
    return HEAD + zlib.crc32(word[-3:]) % TAIL


def _tail_class(word: Column) -> Column:
    last = F.substring(word, -3, 3)
    return (F.lit(HEAD) + F.crc32(last) % TAIL).cast("int")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, given out whenever many words have gathered."""
    seen: Counter[bytes] = Counter()

    def out():
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
        seen.clear()

    for _, texts in pieces(batches):
        for text in texts:
            seen.update((text or "").encode("utf-8", "replace").lower().split())
        seen[END] += len(texts)
        if len(seen) > 250_000:
            yield from out()
    if seen:
        yield from out()


def count_words(docs: DataFrame) -> DataFrame:
    """word (lower-cased bytes), c over all rows of ``docs`` (text); END counts the rows."""
    return docs.select("text").mapInArrow(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Tables:
    """What every task needs: log10(count + 1) of the KNOWN words, classes of the head, and per class
    the log10 of the base and class denominators."""

    def __init__(self, known: dict[bytes, int], head: list[bytes], classes: dict[int, tuple[int, int]], n: int, v: int):
        self.known = {w: float(np.log10(c + 1)) for w, c in known.items()}
        self.head = {w: i for i, w in enumerate(head)}
        self.n, self.v = n, v
        self.base = float(np.log10(n + v + 1))
        # a tail class gives each of its v words c + 1 of n + v + 1 and one unseen word the last part
        self.within = np.zeros(HEAD + TAIL)
        self.within[HEAD:] = [np.log10(sum(classes.get(i, (0, 0))) + 1) for i in range(HEAD, HEAD + TAIL)]
        self.start = np.ones(HEAD + TAIL)
        for i, w in enumerate(head):
            self.start[i] += known.get(w, 0)
        for i, (c, _) in classes.items():
            self.start[i] += c
        if len(head) < HEAD:
            self.start[len(head):HEAD] = 1e-9
        self.start /= self.start.sum()


def prepare(counts: DataFrame) -> Tables:
    """Tables of ``counts`` (word, c)."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = heaviest(counts.where(F.octet_length("word") <= 64), "c", KNOWN, "word").collect()
    top.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    known = {bytes(r["word"]): r["c"] for r in top}
    head = [bytes(r["word"]) for r in top[:HEAD]]
    spark = counts.sparkSession
    own = spark.createDataFrame([(w,) for w in head], "word binary")
    rest = counts.join(F.broadcast(own), "word", "left_anti")  # HEAD words of 64 bytes at most
    classes = {r["k"]: (r["c"], r["v"]) for r in rest.groupBy(_tail_class(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    return Tables(known, head, classes, n, v)


def encode(docs: DataFrame, tables: Tables) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, held_out): the class of each token, sums over the
    tokens whose counts are known here, and the other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        logs = t.known
        classes: dict[bytes, int] = dict(t.head)
        for batch, texts in pieces(batches):
            cols: list[list] = [[] for _ in range(6)]
            for text in texts:
                words = (text or "").encode("utf-8", "replace").lower().split()
                words.append(END)
                row = []
                for w in words:
                    k = classes.get(w)
                    if k is None:
                        if len(classes) > 150_000:
                            classes = dict(t.head)
                        k = classes[w] = tail_class(w)
                    row.append(k)
                ids = np.array(row, dtype=np.uint16)
                logs_ = [logs.get(w) for w in words]
                rare = Counter(w for w, x in zip(words, logs_) if x is None)
                in_ = [x for x in logs_ if x is not None]
                # the words' own part: log10(c + 1) of every known token outside the head classes
                tail = ids >= HEAD
                own = sum(x for x, k in zip(logs_, row) if x is not None and k >= HEAD)
                for col, x in zip(cols, (len(words), ids.tobytes(), len(in_), sum(in_), own - float(t.within[ids[tail]].sum()), list(rare.items()))):
                    col.append(x)
            types = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.map_(pa.binary(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out", "uid")] + [pa.array(c, x) for c, x in zip(cols, types)],
                names=["doc_id", "held_out", "uid", "n_tokens", "ids", "n_here", "log_here", "own_here", "rare"])

    return (docs.withColumn("uid", F.monotonically_increasing_id()).select("doc_id", "held_out", "uid", "text").mapInArrow(
        run, "doc_id long, held_out boolean, uid long, n_tokens long, ids binary, n_here long, log_here double, own_here double, rare map<binary,bigint>"))


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, classes: np.ndarray, states: int = STATES, seed: int = SEED) -> Hmm:
        """The class distribution, disturbed at random for every state; states tend to stay."""
        rng = np.random.default_rng(seed)
        emit = classes * np.exp(rng.normal(0, 0.7, (states, len(classes))))
        move = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(move, 0.95)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _lay(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in descending length, their tokens one after another, and where each begins."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([rows[i] for i in order]).astype(np.int64)
    return order, flat, np.concatenate([[0], np.cumsum(lengths[order])[:-1]])


def log_likelihood(hmm: Hmm, rows: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each row of classes (none empty), by scaled forward recursion."""
    order, flat, begin = _lay(rows)
    lengths = np.array([len(rows[i]) for i in order])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # rows longer than t
    by_class = np.ascontiguousarray(hmm.emit.T)
    total = np.zeros(len(rows))
    alpha = np.broadcast_to(hmm.start, (len(rows), len(hmm.start)))
    scale = np.ones(len(rows))
    for t in range(lengths[0]):
        d = active[t]
        alpha = (alpha[:d] if t == 0 else alpha[:d] @ hmm.move) * by_class[flat[begin[:d] + t]]
        s = alpha.sum(axis=1)
        alpha = alpha / s[:, None]
        scale[:d] *= s
        if t % 16 == 15 or t + 1 == lengths[0]:  # a product of 16 scales cannot vanish
            total += np.log10(scale)
            scale[:] = 1.0
    out = np.empty(len(rows))
    out[order] = total
    return out


def expected(hmm: Hmm, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions over rows of classes (none empty)."""
    order, flat, begin = _lay(rows)
    lengths = np.array([len(rows[i]) for i in order])
    steps, k = int(lengths[0]), len(hmm.start)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    by_class = np.ascontiguousarray(hmm.emit.T)
    alphas, scales, emits = [], [], []
    for t in range(steps):
        d = active[t]
        e = by_class[flat[begin[:d] + t]]
        a = (np.broadcast_to(hmm.start, (d, k)) if t == 0 else alphas[-1][:d] @ hmm.move) * e
        s = a.sum(axis=1)
        alphas.append(a / s[:, None])
        scales.append(s)
        emits.append(e)
    moves = np.zeros((k, k))
    weight = np.empty((len(flat), k))
    beta = np.ones((active[-1], k))
    for t in range(steps - 1, -1, -1):
        d = active[t]
        if len(beta) < d:  # rows whose last token this is
            beta = np.concatenate([beta, np.ones((d - len(beta), k))])
        weight[begin[:d] + t] = alphas[t] * beta
        if t:
            back = emits[t] * beta / scales[t][:, None]
            moves += alphas[t - 1][:d].T @ back
            beta = back @ hmm.move.T
    emission = np.stack([np.bincount(flat, weights=weight[:, j], minlength=hmm.emit.shape[1]) for j in range(k)])
    return weight[begin].sum(axis=0), moves * hmm.move, emission


def baum_welch(encoded: DataFrame, tables: Tables, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Train on the rows of ``encoded`` that are not held out."""
    hmm = Hmm.initial(tables.start, states)
    rows = encoded.where("NOT held_out").select("ids")
    spark, width = encoded.sparkSession, len(tables.start)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(hmm)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            sums = [np.zeros(states), np.zeros((states, states)), np.zeros((states, width))]
            held: list[np.ndarray] = []

            def add():
                for total, x in zip(sums, expected(m, held)):
                    total += x
                held.clear()

            for batch in batches:
                for ids in batch.column(0).to_pylist():
                    ids = np.frombuffer(ids, np.uint16)
                    held += [ids[i: i + STRETCH] for i in range(0, len(ids), STRETCH)]
                    if len(held) >= 600:
                        add()
            if held:
                add()
            flat = np.rint(np.concatenate([x.ravel() for x in sums]) * _UNIT).astype(np.int64)
            at = np.nonzero(flat)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["cell", "x"])

        got = rows.mapInArrow(run, "cell long, x long").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
        cells = np.zeros(states + states * states + states * width)  # as many rows at most
        cells[got["cell"].to_numpy(np.int64)] = got["x"].to_numpy(np.float64) / _UNIT
        start, move, emit = np.split(cells, [states, states + states * states])
        start, move, emit = start + 1.0, move.reshape(states, states) + 1.0, emit.reshape(states, width) + tables.start
        hmm = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        shared.destroy()
    return hmm


def score(encoded: DataFrame, counts: DataFrame, tables: Tables, hmm: Hmm) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(hmm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            rows = [np.frombuffer(x, np.uint16) for x in batch.column(at).to_pylist()]
            out = np.concatenate([log_likelihood(m, rows[i: i + 2500]) for i in range(0, len(rows), 2500)]) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(out)],
                                             names=[*[c for c in batch.schema.names if c != "ids"], "path"])

    cols = ["doc_id", "held_out", "uid", "n_tokens", "n_here", "log_here", "own_here"]
    types = "doc_id long, held_out boolean, uid long, n_tokens long, n_here long, log_here double, own_here double, path double"
    paths = encoded.select(*cols, "ids").mapInArrow(run, types)
    words = encoded.select("uid", F.explode("rare").alias("word", "tf"))
    found = (words.join(counts, "word").groupBy("uid")
             .agg(F.sum("tf").alias("n_rare"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("log_rare")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (paths.join(found, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_here") + zero("n_rare")).cast("long").alias("n_known"),
        F.lit(tables.n).cast("long").alias("train_tokens"),
        (F.col("log_here") + zero("log_rare") - F.col("n_tokens") * F.lit(tables.base)).alias("base_score"),
        (F.col("path") + F.col("own_here") + zero("log_rare")).alias("score")))


def model_scores(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows of ``docs`` (doc_id, text) that ``held_out`` does not hold for, and
    score all rows: base_score is the add-one unigram's log10 probability, score the hidden
    Markov model's.  A null text is empty (its end is its only token); null and repeated
    doc_ids are rows like others; other columns are not read; an empty table gives no rows;
    without training rows every class is as likely.
    """
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    counts = stash(count_words(docs.where("NOT held_out")), "hmm-counts")
    tables = prepare(counts)
    encoded = stash(encode(docs, tables), "hmm-encoded")
    return score(encoded, counts, tables, baum_welch(encoded, tables, states, rounds))


def op9(docs: DataFrame) -> DataFrame:
    return model_scores(docs, in_fold(F.col("doc_id"), 7, 2))
