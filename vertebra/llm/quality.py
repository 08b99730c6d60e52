"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document.  Expectation-maximisation over the
votes of all documents estimates how many documents are good or of each kind of bad, and
per rule, how often it votes each way on them; a document is kept if its posterior probability of being good is high enough.
All documents enter as counts of vote patterns (3 ** rules at most), so the estimate needs
one aggregation however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stash

# fixed values: the symbols counted, and the characters between words
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")
#: A rule: its name, a measure over FEATURES, at most which value it votes good, from which
#: bad, and the share of its bad votes that are believed right to begin with.
RULES = (
    ("symbols per word", lambda f: f["n_symbols"] / f["n_words"], 0.05, 0.15, 0.98),
    ("duplicate lines", lambda f: f["n_dup_lines"] / f["n_lines"], 0.05, 0.30, 0.9),
    ("repeated words", lambda f: f["n_repeat_words"] / f["n_words"], 0.05, 0.20, 0.95),
    ("capitals", lambda f: f["n_upper"] / f["n_letters"], 0.20, 0.60, 0.95),
    ("exclamation marks per word", lambda f: f["n_marks"] / f["n_words"], 0.10, 0.50, 0.95),
    ("mean word length off 6", lambda f: F.abs(f["word_chars"] / f["n_words"] - 6), 2.5, 5.0, 0.7),
    ("few words", lambda f: 25.0 / f["n_words"], 0.8, 2.5, 0.5),
)


def repeated(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found twice or more, the first one included."""
    n = len(words) - 4
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    key, size = ids[:n], len(number)
    for i in range(1, 5):  # equal keys are equal windows: keys are renumbered before they can overflow
        if size > 2 ** 62 // len(number):
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key, size = key * len(number) + ids[i: n + i], size * len(number)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(words), dtype=bool)
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    for i in range(5):
        hit[twice + i] = True
    return int(hit.sum())


def _differ(a: str, b: str) -> int:
    """Places where two texts differ (over the shorter, if case changes lengths)."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
    n = min(len(x), len(y))
    return int((x[:n] != y[:n]).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """FEATURES of a text; a null text has none of anything."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines, seen, dup, count = text.split("\n"), set(), 0, 0
    for line in lines:
        if line.strip(SPACES):
            count += 1
            dup += line in seen
            seen.add(line)
    small, capital = text.lower(), text.upper()
    upper, letters = _differ(text, small), _differ(small, capital)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated(words), count,
            upper, letters, text.count("!"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            rows = [measure(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows)]], names=["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", *[f"{f} long" for f in FEATURES]]))


#: Share of its own kind of bad document that a rule is believed to find to begin with.
OWN = 0.9
#: Weight of the beliefs, in documents: they fade as documents speak.
BELIEF = 100.0


def vote(measured: DataFrame) -> DataFrame:
    """Adds pattern: one digit per rule, 0 bad, 1 abstain, 2 good.  A measure that does not
    exist (no words, lines or letters) abstains."""
    f = {c: F.col(c) for c in FEATURES} | {c: F.when(F.col(c) > 0, F.col(c)) for c in ("n_words", "n_lines", "n_letters")}
    digits = []
    for _, value, good, bad, _ in RULES:
        x = value(f)
        digits.append(F.when(x <= good, "2").when(x >= bad, "0").otherwise("1"))
    return measured.withColumn("pattern", F.concat(*digits))


def estimate(patterns: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, from the numbers of documents.

    The classes are the good documents and one kind of bad document for each rule that is
    believed right more often than not; a document is good, or of one kind.  Votes are
    independent given the class, and an abstention says nothing.  Each kind starts with
    the share of documents its rule's right votes make up, as one that this rule finds and
    the others do not know.  From there shares and rates follow the documents: rules that
    fire together fire together on a kind, and do not claim bad documents of another kind
    for themselves.  Votes cannot tell whether a rule that fires alone is right: there the
    start remains, however many documents there are.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    n = np.array([patterns[k] for k in keys], dtype=np.float64)
    votes = np.array([[int(c) for c in k] for k in keys])
    marks = np.stack([votes == 0, votes == 2], axis=2).astype(np.float64)  # pattern, rule, bad or good
    fired = (n @ marks[:, :, 0] + 0.1) / (n.sum() + 1)
    precise = np.array([r[-1] for r in RULES])
    kinds = np.nonzero(precise > 0.5)[0]
    bad = float(precise[kinds] @ fired[kinds])
    start = np.append(precise[kinds] * fired[kinds], max(1 - bad, bad))  # kinds, good; rules overlap where bad is large
    start /= start.sum()
    of_bad = np.tile((1 - precise) * fired, (len(start), 1))  # class, rule
    of_bad[np.arange(len(kinds)), kinds] = OWN
    first = np.stack([of_bad, 1 - of_bad], axis=2)
    prior, like, post = start, first, None
    for _ in range(rounds):
        logs = np.log(prior)[:, None] + np.einsum("prv,crv->cp", marks, np.log(like))
        post = np.exp(logs - logs.max(axis=0))
        post /= post.sum(axis=0)
        weight = post * n
        prior = (weight.sum(axis=1) + BELIEF * start) / (n.sum() + BELIEF)
        like = np.einsum("cp,prv->crv", weight, marks) + BELIEF * start[:, None, None] * first
        like /= like.sum(axis=2, keepdims=True)
    return dict(zip(keys, post[-1].tolist()))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, FEATURES, base_failed, posterior and kept of every row of ``docs``.

    base_failed: under 10 words, or over 20 % of the words in repeated windows; such rows
    are not kept.  Others are kept if their posterior is ``least`` or more.  A null text
    has no words; null and repeated doc_ids are rows like others; other columns are not
    read; an empty table gives no rows.
    """
    rows = stash(vote(features(docs)), "quality-votes")
    counts = {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** rules at most
    posterior = estimate(counts)
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(list(posterior.items()), "pattern string, posterior double"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (rows.join(table, "pattern").withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("posterior") >= least))
            .select("doc_id", *FEATURES, "pattern", "base_failed", "posterior", "kept"))


def op10(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
