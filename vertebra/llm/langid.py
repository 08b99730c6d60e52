"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes with frozen counts.  A
byte's code length in a context is -log2(count / (total + distinct)); a byte that the
context has not seen costs the escape -log2(distinct / (total + distinct)) plus its code
length in the next shorter context, down to the uniform distribution (method C without
exclusions).  The language of the shortest code wins.

A language's tree is laid out as ordered arrays, so a batch of texts is scored without a
loop over bytes: each distinct n-gram of the batch is looked up once per language and depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, in_fold, pieces, stash

ORDER = 3
#: Rows of the training sample and n-grams kept, over all languages.
SAMPLE, GRAMS = 12_000, 250_000
#: What every language gets of them at least, if it has as many.
LEAST_ROWS, LEAST_GRAMS = 100, 10_000
#: Texts of more bytes count as so many when code lengths become a probability.
EVIDENCE = 64.0
UNKNOWN = "und"
_PAD = 256


def _codes(data: list[bytes]) -> np.ndarray:
    """Of every byte, the code of its context of ORDER bytes (padded before the start) and itself."""
    row = np.full(sum(map(len, data)) + ORDER * len(data), _PAD, dtype=np.int64)
    at, ends = 0, []
    for d in data:
        row[at + ORDER: at + ORDER + len(d)] = np.frombuffer(d, np.uint8)
        at += ORDER + len(d)
        ends.append(at)
    code = np.zeros(max(len(row) - ORDER, 0), dtype=np.int64)
    for i in range(ORDER + 1):
        code = code * 257 + row[i: i + len(code)]
    return code[row[ORDER:] != _PAD] if len(code) else code


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches):
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for lang in sorted(set(langs)):
            code, n = np.unique(_codes([t.encode("utf-8", "replace") for t, x in zip(texts, langs) if x == lang and t]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the sum of n and the number of rows of each."""
    kinds, where = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(where, weights=n, minlength=len(kinds)), np.bincount(where, minlength=len(kinds))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every wanted key in the ordered keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Model:
    """Context trees of the languages ``langs``, one each.  Per language and depth: the known
    bytes in their contexts with their code lengths, the known contexts with their escapes."""

    def __init__(self, langs: list[str], codes: np.ndarray, lang: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.trees = []
        order = np.argsort(lang, kind="stable")
        ends = np.searchsorted(lang[order], np.arange(len(langs) + 1))
        for at, end in zip(ends, ends[1:]):
            code, m, tree = codes[order[at:end]], n[order[at:end]], []
            for depth in range(ORDER + 1):
                gram, freq, _ = _sums(code % 257 ** (depth + 1), m)
                context, total, distinct = _sums(gram // 257, freq)
                own = -np.log2(freq / (total + distinct)[_find(context, gram // 257)[0]])
                tree.append((gram, own.astype(np.float32), context, (-np.log2(distinct / (total + distinct))).astype(np.float32)))
            self.trees.append(tree)

    def _costs(self, tree, codes: np.ndarray) -> np.ndarray:
        """Code length of every byte (``codes`` as of _codes, distinct and ordered) in one language."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for depth in range(ORDER, -1, -1):
            gram, own, context, escape = tree[depth]
            wanted = codes[left] % 257 ** (depth + 1)
            at, there = _find(gram, wanted)
            out[left[there]] += own[at[there]]
            left, wanted = left[~there], wanted[~there] // 257
            at, there = _find(context, wanted)
            out[left[there]] += escape[at[there]]
        out[left] += 8.0
        return out

    def bits(self, data: list[bytes]) -> np.ndarray:
        """Code length of each byte string (a row) in each language (a column)."""
        lengths = np.array([len(d) for d in data], dtype=np.int64)
        out = np.zeros((len(data), len(self.langs)))
        full = lengths > 0
        if not full.any():
            return out
        codes, where = np.unique(_codes(data), return_inverse=True)  # the same few n-grams, again and again
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[full]
        for i, tree in enumerate(self.trees):
            out[full, i] = np.add.reduceat(self._costs(tree, codes)[where], begin)
        return out


def level(sizes: list[int], bound: int, least: int) -> float:
    """The share of each of several sizes if ``bound`` is dealt out evenly and what small ones
    leave goes to the others; ``least`` at least."""
    left = float(bound)
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return max(left / (len(sizes) - i), least)
        left -= n
    return float(max([least, *sizes]))


def _draw(*cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def heaviest_of_each(grams: DataFrame) -> DataFrame:
    """The n-grams (lang, code, n) of largest n of each language: about GRAMS in all, dealt out
    by ``level``.  The last step of n that has room (a sixteenth of a doubling) is thinned by a hash."""
    step = F.floor(F.log2("n") * 16)
    steps = grams.groupBy("lang", step.alias("s")).agg(F.count("*").alias("c")).orderBy("lang", F.desc("s")).collect()
    sizes: dict[str, int] = {}
    for r in steps:
        sizes[r["lang"]] = sizes.get(r["lang"], 0) + r["c"]
    share = level(list(sizes.values()), GRAMS, LEAST_GRAMS)
    cuts, used = {}, dict.fromkeys(sizes, 0)
    for r in steps:
        room = share - used[r["lang"]]
        if room > 0:
            cuts[r["lang"]] = (r["lang"], r["s"], min(1.0, room / r["c"]))
        used[r["lang"]] += r["c"]
    table = grams.sparkSession.createDataFrame(list(cuts.values()), "lang string, cut long, part double")
    return (grams.join(F.broadcast(table), "lang").where((step > F.col("cut")) | ((step == F.col("cut")) & (_draw("code") < F.col("part"))))
            .select("lang", "code", "n"))


def fit(docs: DataFrame, train=None, sample: int = SAMPLE) -> Model:
    """Learn the languages from the rows of ``docs`` (doc_id, text, lang) that ``train`` (a
    Column) holds for; rows without text or lang teach nothing.

    Every language that has a text is learned, however rare it is.  About ``sample`` rows are
    used, chosen by a hash of doc_id and text and dealt out evenly: all rows of a language with
    few, LEAST_ROWS of every other at least.  So are the n-grams (GRAMS, LEAST_GRAMS).  Over
    ``sample`` / LEAST_ROWS languages the sample, over GRAMS / LEAST_GRAMS the model grows with
    their number.
    """
    train = F.lit(True) if train is None else train
    rows = (docs.select("doc_id", "text", "lang").where(train & F.col("lang").isNotNull() & (F.col("text") != ""))
            .withColumn("draw", _draw("doc_id", "text")))
    each = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("first")).collect()
    if not each:
        return Model([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    share = level([r["n"] for r in each], sample, LEAST_ROWS)
    upto = docs.sparkSession.createDataFrame([(r["lang"], max(r["first"], share / r["n"])) for r in each], "lang string, upto double")
    some = rows.join(F.broadcast(upto), "lang").where(F.col("draw") <= F.col("upto"))
    grams = stash(some.select("text", "lang").mapInArrow(_count, "lang string, code long, n long")
                  .groupBy("lang", "code").agg(F.sum("n").alias("n")), "ppm-grams")
    kept = heaviest_of_each(grams).toPandas().sort_values(["lang", "code"])
    langs = sorted(set(kept["lang"]))
    number = {x: i for i, x in enumerate(langs)}
    return Model(langs, kept["code"].to_numpy(np.int64), kept["lang"].map(number).to_numpy(np.int64), kept["n"].to_numpy(np.float64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (text among them), lang_pred and score, the probability of
    lang_pred (columns of these names give way).  Null texts and texts without a letter are ``und`` with score 0, as
    is everything if no language was learned; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "_letters")]
    docs = docs.select(*keep, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema][:-1] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("langid")  # nothing, but what other stages kept goes
        m = shared.value
        for batch, texts in pieces(batches):
            letters = batch.column(batch.num_columns - 1).to_numpy(False)
            pred = np.full(len(texts), -1)
            p = np.zeros(len(texts))
            go = np.nonzero(letters)[0] if m.langs else []
            for at in range(0, len(go), 64):
                part = go[at: at + 64]
                data = [texts[i].encode("utf-8", "replace") for i in part]
                bits = m.bits(data)
                size = np.array([max(len(d), 1) for d in data])
                x = -bits * np.log(2.0) * np.minimum(1.0, EVIDENCE / size)[:, None]
                x = np.exp(x - x.max(axis=1, keepdims=True))
                x /= x.sum(axis=1, keepdims=True)
                pred[part] = bits.argmin(axis=1)
                p[part] = x[np.arange(len(part)), pred[part]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([m.langs[i] if i >= 0 else UNKNOWN for i in pred], pa.string()), pa.array(p, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op8(docs: DataFrame) -> DataFrame:
    held = in_fold(F.col("doc_id"), 5, 0)
    model = fit(docs, ~held)
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
