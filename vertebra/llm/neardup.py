"""Near-duplicate documents by circulant MinHash, with exact Jaccard verification.

A document's set holds its distinct five-word shingles as 64-bit fingerprints.  Circulant
MinHash needs two permutations: sigma (a mixing hash onto a circle of slots) places the
shingles, and coordinate k of the signature is the minimum of pi, shifted k places round
the circle.  The coordinates of one shingle are therefore consecutive entries of pi, and a
document's signature is one gather and one minimum.

Bands of four coordinates give buckets.  Rather than all pairs of a bucket, each member is
verified against the smallest members of its buckets (stars), and verified links are
contracted to components.  Only buckets whose members still belong to different components
are looked at again: a member whose signature agrees enough with one of another component
asks that component, and is held against its members' full sets until one is linked.  Those
for whom that leaves components meet the members of their buckets once more, with their
texts, and give out the links alone.  So
no link that the bands found is lost, and no step gives out the pairs of a group.  Copies
of one set are a single node throughout.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, pieces, stash

SHINGLE = 5
PERCENT = 75
COORDS, ROWS = 128, 4
BANDS = COORDS // ROWS
CIRCLE = 1 << 20
SEED = 20240229
#: Partners of a star task, rows of a bucket task, members outside the largest component,
#: and documents of either side of an asking task.
STAR, BLOCK, OUTSIDE, SIDE = 128, 2048, 1024, 1024
#: Coordinates (of 128) that must agree before a pair is verified on full sets; at a
#: similarity of 0.75 fewer agree with a chance of about 1e-7.
AGREE = 70

_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


#: Components that a node asks in a bucket before it meets all; candidates that it is held
#: against there at a time.
ASKED, MORE = 1, 64
#: Shingles of either side of a block that is verified where it meets (8 bytes each).
HEAVY = 2_000_000
#: Words whose fingerprints a worker keeps.
WORDS = 20_000
#: Groups too small to be worth a call of their own share one ("cell"): pairs, rows of buckets
#: and shingles of one, on average.
CELL_PAIRS, CELL_ROWS, CELL_SHINGLES = 64, 512, 500_000
#: How often a crowded bucket is split by more coordinates.  Members of one are alike, so those
#: that share two more coordinates are most of them, and 62 twos would hold each pair many
#: times; whole, it holds a pair once and its blocks are compared fast.
SPLITS = 0
#: Bytes of text that are hashed at once; pairs whose signatures are compared at once.
TEXT, TILE = 1 << 18, 1 << 13


def row_id() -> Column:
    """What tells rows apart: a doc_id may be repeated with another text."""
    return F.xxhash64("doc_id", "text")


class _Words(dict):
    """64-bit fingerprints of words, kept for the words seen first: common ones are among them,
    and emptying it again and again cost more than it saved."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS:
            self[word] = h
        return h


def _fingerprints() -> _Words:
    """One of them per Python worker."""
    kept = held("near-dedup")
    if "words" not in kept:
        kept["words"] = _Words()
    return kept["words"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Sorted distinct fingerprints of the shingles of texts given as words."""
    ends = np.cumsum([len(w) for w in texts])
    h = np.fromiter(map(_fingerprints().__getitem__, itertools.chain.from_iterable(texts)), dtype=np.uint64, count=int(ends[-1]))
    placed = [_mix(h + place) for place in _PLACE]

    def of(at: int, end: int, width: int) -> np.ndarray:
        acc = np.full(end - at - width + 1, np.uint64(width), dtype=np.uint64)
        for i in range(width):
            acc *= _PLACE[4]
            acc += placed[i][at + i: end - width + 1 + i]
        return _mix(acc)

    whole = of(0, len(h), SHINGLE) if len(h) >= SHINGLE else None
    out = []
    for words, end in zip(texts, ends.tolist()):
        n = len(words)
        if n < SHINGLE:
            out.append(of(end - n, end, n) if n else np.zeros(0, np.uint64))
            continue
        acc = np.sort(whole[end - n: end - SHINGLE + 1])
        out.append(acc[np.concatenate([[True], acc[1:] != acc[:-1]])])
    return out


def shingle_sets(texts: Iterable[str | None]) -> list[np.ndarray]:
    """Of each text, the sorted distinct fingerprints of its shingles (of the whole sequence, if
    it is shorter).  Texts are hashed together, ``TEXT`` bytes (one text at least) at a time."""
    out: list[np.ndarray] = []
    ready, total = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        if ready and total + len(raw) > TEXT:
            out += _sets(ready)
            ready, total = [], 0
        ready.append(raw.lower().split())
        total += len(raw)
    return out + _sets(ready) if ready else out


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


@functools.cache
def _windows() -> np.ndarray:
    """Row s: pi at s, s + 1, ... s + 127 round the circle, as a view."""
    pi = np.random.default_rng(SEED).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: COORDS - 1]]), COORDS)


def signature(shingles: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The coordinates of a non-empty set."""
    slots = (shingles * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)  # sigma
    sig = np.full(COORDS, CIRCLE, dtype=np.uint32)
    for i in range(0, len(slots), 4096):
        np.minimum(sig, windows[slots[i: i + 4096]].min(axis=0), out=sig)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, of a signature or a table of them; the band's number is part of it."""
    part = sig.reshape(*sig.shape[:-1], BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * _PLACE[0] + part[..., i])
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    windows = _windows()
    for batch, texts in pieces(batches):
        sets = shingle_sets(texts)
        n = [len(s) for s in sets]
        digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        sigs = [signature(s, windows) if len(s) else None for s in sets]
        some = [s for s in sigs if s is not None]
        keys = pa.array(band_keys(np.stack(some)).ravel() if some else [], pa.int64())
        keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [BANDS * (k > 0) for k in n]), pa.int32()), keys)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id")], pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
             keys, pa.array([None if s is None else s.astype(np.uint8).tobytes() for s in sigs], pa.binary())],
            names=["row", "doc_id", "n_shingles", "digest", "keys", "sig"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def _shared(mark: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many of each of ``sets`` (numbers, none empty) are marked."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.add.reduceat(mark[np.concatenate(sets)], starts, dtype=np.int64)


def _cells(total: int, most: int, *by: str | Column) -> Column:
    """The cell of a group: groups of ``total`` in all share calls of about ``most``."""
    return F.pmod(F.xxhash64(*by), F.lit(max(1, -(-total // most)))).alias("cell")


def _groups(pdf: pd.DataFrame, by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The groups of a cell, by key."""
    at = [pdf[c].to_numpy(np.int64) for c in by]
    order = np.lexsort(at[::-1])
    pdf, at = pdf.iloc[order], np.stack([a[order] for a in at])
    new = np.flatnonzero(np.concatenate([[True], (at[:, 1:] != at[:, :-1]).any(axis=0)])) if len(pdf) else np.zeros(0, np.int64)
    for start, end in zip(new.tolist(), [*new.tolist()[1:], len(pdf)]):
        yield tuple(at[:, start].tolist()), pdf.iloc[start:end]


def _each(run):
    """``run`` for each bucket's block of a cell."""

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [run(group) for _, group in _groups(pdf.drop(columns="cell"), ["bkey", "g", "s"])]
        return pd.concat([o for o in out if len(o)] or out[:1], ignore_index=True)

    return cell


def _verify(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Those pairs (a, b) of the right that are linked; the left has the text of every a."""
    found: list[tuple[int, int]] = []
    mine = dict(zip(left["la"].tolist(), shingle_sets(left["left_text"])))
    right = right.drop_duplicates(["a", "b"])
    for a, b, other in zip(right["a"].tolist(), right["b"].tolist(), shingle_sets(right["right_text"])):
        if a in mine and _linked(mine[a], other):
            found.append((a, b))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def texts_of(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``name`` and text of the rows of ``docs`` whose ``row_id`` is in ``ids`` (one column).

    A bitmap of 2^24 hashed ids (2 MB at most, so it is broadcast) keeps the text of most
    other rows from being moved; the merge join that follows decides.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << 24))
    ids = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    bits = ids.groupBy(F.bitmap_bucket_number(slot("id")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot("id"))).alias("bits"))
    at = F.bitmap_bit_position(slot("row")).cast("int")
    byte = F.conv(F.hex(F.expr("substring(bits, at div 8 + 1, 1)")), 16, 10).cast("int")
    return (docs.select(row_id().alias("row"), "text").select("row", "text", F.bitmap_bucket_number(slot("row")).alias("bucket"), at.alias("at"))
            .join(F.broadcast(bits), "bucket").where(F.getbit(byte, F.col("at") % 8) == 1)
            .select(F.col("row").alias(name), "text"))


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough.  A hot ``a`` is split:
    its text goes along with every ``STAR`` partners; cold ones share a cell."""
    pairs = stash(pairs.distinct(), "dedup-pairs")
    cell = functools.partial(_cells, pairs.count(), CELL_PAIRS)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    left = (many.hint("merge").join(texts_of(docs, many.select("a"), "a"), "a")
            .select(F.col("a").alias("la"), F.col("text").alias("left_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("ls"))
            .select("la", "left_text", cell("la", "ls")))
    right = (pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
             .hint("merge").join(texts_of(docs, pairs.select("b"), "b"), "b").select("a", "b", F.col("text").alias("right_text"), cell("a", "salt")))
    return stash(left.groupBy("cell").cogroup(right.groupBy("cell"))
                 .applyInPandas(_verify, "a long, b long").distinct(), "dedup-links")


def components(links: DataFrame) -> DataFrame:
    """node, root for the nodes of ``links`` (a, b) that reach a smaller one: the smallest.

    Each round hooks every root to its smallest neighbour, shortens the hooks twice and
    contracts the links; only links between different roots go on.
    """
    e = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-links")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    while not e.isEmpty():
        up = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        for _ in range(2):
            over = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
            up = up.join(over, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
        roots = _follow(roots, stash(up, "cc-hooks"))
        e = stash(_contract(e, roots), "cc-links")
    return roots


def _follow(roots: DataFrame, up: DataFrame) -> DataFrame:
    """``roots`` after its roots were hooked by ``up``, and the new hooks."""
    on = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
    moved = roots.join(on, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
    return stash(moved.unionByName(up).groupBy("node").agg(F.min("root").alias("root")), "cc-roots")


def _contract(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The links (a, b) between different roots, a > b."""
    of_a, of_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    return (links.join(of_a, "a", "left").join(of_b, "b", "left")
            .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())


def merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` with more links."""
    more = stash(_contract(links, roots), "cc-more")
    return roots if more.isEmpty() else _follow(roots, components(more))


def _members(pdf: pd.DataFrame) -> pd.DataFrame:
    """Those who meet, each once; one that asks, asking."""
    node, asks = pdf["node"].to_numpy(np.int64), pdf["asks"].to_numpy(bool)
    order = np.lexsort((~asks, node))
    order = order[np.concatenate([[True], node[order[1:]] != node[order[:-1]]])]
    return pdf.iloc[order[np.lexsort((node[order], ~asks[order]))]]


def _agreement(some: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Coordinates (128 bytes a row) in which each of ``some`` agrees with each of ``sig``."""
    same = (some[:, None, :] == sig[None, :, :]).view(np.uint64).sum(axis=2)  # eight counts of 16 at most
    return (same * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _candidates(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Of members outside the bucket's largest component (``asks``): the rows of other components
    whose signature agrees enough, the likeliest first.  Between two that are ``outside``, the
    smaller asks; components in ``asked`` were asked before.  With the members' ``keys``, two that
    share an earlier band are left to that band's bucket: they meet there, if it was not settled."""
    node, comp, cur = (pdf[c].to_numpy(np.int64) for c in ("node", "comp", "cur"))
    n, asks, outside = pdf["n"].to_numpy(np.int64), pdf["asks"].to_numpy(bool), pdf["outside"].to_numpy(bool)
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(len(pdf), COORDS)
    asked = pdf["asked"].tolist()
    keys = np.stack(pdf["keys"].tolist()) if "keys" in pdf else np.zeros((len(pdf), 0), np.int64)
    earlier = keys[:, :_band(keys, pdf)]
    who = np.nonzero(asks)[0]
    step = max(1, TILE // len(pdf))
    for some in (who[k: k + step] for k in range(0, len(who), step)):
        mine = n[some, None]
        like = (cur != cur[some, None]) & (100 * np.minimum(n, mine) >= PERCENT * np.maximum(n, mine)) & (~outside | (node > node[some, None]))
        agrees = _agreement(sig[some], sig).astype(np.int64)
        like &= agrees >= AGREE
        for i, agree, row in zip(some, agrees, like):
            at = np.nonzero(row)[0]
            if len(at) and asked[i] is not None:
                at = at[~np.isin(comp[at], np.asarray(asked[i], dtype=np.int64))]
            if len(at) and earlier.shape[1]:
                at = at[~(earlier[at] == earlier[i]).any(axis=1)]
            yield i, at[np.lexsort((node[at], -agree[at]))]


def _band(keys: np.ndarray, pdf: pd.DataFrame) -> int:
    """The band whose bucket this is; 0 for one that was split by other coordinates too."""
    found = np.flatnonzero(keys[0] == pdf["bkey"].iloc[0]) if keys.shape[1] else []
    return int(found[0]) if len(found) else 0


def _matches(limit: int):
    """Members that ask, and the components of their candidates: ``limit`` of them, the
    likeliest first, and whether there are more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _members(pdf)
        node, comp = (pdf[c].to_numpy(np.int64) for c in ("node", "comp"))
        found: list[tuple[int, int, bool]] = []
        for i, at in _candidates(pdf):
            best = comp[at]
            best = best[np.sort(np.unique(best, return_index=True)[1])]
            found += [(node[i], c, len(best) > limit) for c in best[:limit]]
        return pd.DataFrame(found, columns=["b", "comp", "more"]).astype({"b": "int64", "comp": "int64", "more": "bool"})

    return run


def _partners(pdf: pd.DataFrame) -> pd.DataFrame:
    """Those who meet that have a candidate or are one: a row of each, not of their pairs."""
    pdf = _members(pdf)
    there = np.zeros(len(pdf), dtype=bool)
    for i, at in _candidates(pdf):
        if len(at):
            there[i] = there[at] = True
    return pdf[there]


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between those who meet (with ``text``), by their full sets: every candidate is held
    against who asks unless links found here join the two already, so there are fewer links
    than members."""
    pdf = _members(pdf)
    sets = shingle_sets(pdf["text"])
    size = np.array([len(s) for s in sets])
    known, number = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(number, np.cumsum(size)[:-1])
    node, now = pdf["node"].to_numpy(np.int64), pdf["cur"].to_numpy(np.int64).copy()
    mark = np.zeros(len(known), dtype=bool)
    found: list[tuple[int, int]] = []
    for i, at in _candidates(pdf):
        mark[own[i]] = True
        for part in (at[k: k + MORE] for k in range(0, len(at), MORE)):
            part = part[now[part] != now[i]]
            if not len(part):
                continue
            both = _shared(mark, [own[j] for j in part])
            for j in part[(both > 0) & (100 * both >= PERCENT * (size[i] + size[part] - both))]:
                if now[j] != now[i]:
                    found.append((node[j], node[i]))
                    now[now == now[j]] = now[i]
        mark[own[i]] = False
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _meet(rows: DataFrame, nodes: DataFrame, depth: int, asked: DataFrame | None, run, schema: str, heavy: int | None = None) -> DataFrame:
    """What ``run`` makes of members of buckets that may be linked to one of another component.
    ``rows`` (bkey, node, comp, cur, n, band, last) are members of buckets, ``cur`` the component
    that ``comp`` is part of by now.  Only members outside a bucket's largest ``comp`` ask, which
    is the same in every round; from the second on, those in ``asked`` (node, asked: the
    components asked before), in the buckets that they are in.  They meet in blocks, with
    ``heavy`` also of so many shingles.  With ``depth``, a bucket with many members outside its
    largest component is split first, so many times at most, by two coordinates next to each
    other, outside the band and after the ``last`` two.  Of the other 62 twos, AGREE coordinates
    fill four at least, so a pair that agrees enough meets whatever the size of its bucket."""
    per = rows.groupBy("bkey", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    kinds = per.groupBy("bkey").agg(F.sum("c").alias("all"), F.sum("w").alias("heft"), F.max(F.struct("c", "comp", "w")).alias("top"), F.count("*").alias("k"))
    open_ = kinds.where("k > 1").select("bkey", F.col("top.comp").alias("big"), "all", (F.col("all") - F.col("top.c")).alias("out"),
                                        "heft", (F.col("heft") - F.col("top.w")).alias("heft_out"))
    if asked is not None:
        open_ = open_.join(rows.join(asked, "node", "left_semi").select("bkey").distinct(), "bkey", "left_semi")
    rows = stash(rows.join(open_, "bkey"), "dedup-open")
    ready = rows.where(F.col("out") <= OUTSIDE) if depth else rows
    parts = lambda count, most, heft: F.ceil(F.greatest(F.col(count) / most, F.col(heft) / heavy) if heavy else F.col(count) / most).cast("int")
    groups, blocks = parts("out", OUTSIDE, "heft_out"), parts("all", BLOCK, "heft")
    deal = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    member = ["bkey", "node", "comp", "cur", "n", F.expr("comp <> big").alias("outside")]
    asking = ready.where("comp <> big").select(*member, deal(groups, 3).alias("g"), F.explode(upto(blocks)).alias("s"), F.lit(True).alias("asks"))
    before = F.lit(None).cast("array<long>").alias("asked")
    asking = asking.withColumn("asked", before) if asked is None else asking.join(asked, "node")
    others = ready.select(*member, F.explode(upto(groups)).alias("g"), deal(blocks, 4).alias("s"), F.lit(False).alias("asks")).withColumn("asked", before)
    both = asking.select(others.columns).unionByName(others).join(nodes.select("node", "sig", "keys"), "node")
    found = both.withColumn("cell", _cells(rows.count(), CELL_ROWS, "bkey", "g", "s")).groupBy("cell").applyInPandas(_each(run), schema)
    if depth and not (crowded := rows.where(F.col("out") > OUTSIDE)).isEmpty():
        band = F.coalesce("band", F.array_position("keys", F.col("bkey")).cast("int") - 1)
        finer = crowded.join(nodes.select("node", "keys", "sig"), "node").select(
            "node", "comp", "cur", "n", "bkey", "sig", "last", band.alias("band"), F.explode(F.sequence(F.lit(0), F.lit(COORDS // 2 - 1))).alias("two")).where(
            f"two > last AND two div {ROWS // 2} <> band").select(
            F.xxhash64("bkey", "two", F.expr("substring(sig, 2 * two + 1, 2)")).alias("bkey"), "node", "comp", "cur", "n", "band", F.col("two").alias("last"))
        found = found.unionByName(_meet(finer, nodes, depth - 1, asked, run, schema, heavy))
    return found


def _asks(rows: DataFrame, nodes: DataFrame, depth: int, limit: int, asked: DataFrame | None) -> DataFrame:
    """b, comp, more: node b may be linked to a member of another component; with ``more`` also
    to others than those given out.  The others as in ``_meet``."""
    found = _meet(rows, nodes, depth, asked, _matches(limit), "b long, comp long, more boolean")
    return stash(found.groupBy("b", "comp").agg(F.bool_or("more").alias("more")), "dedup-asks")


def settle(rows: DataFrame, nodes: DataFrame, asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join whatever is linked among the nodes in ``asked`` and the members of
    their buckets (``rows``, ``asked`` as in ``_meet``).  Texts go to where members meet, and
    only links are given out: no step has a row per pair."""
    met = stash(_meet(rows, nodes, SPLITS, asked, _partners, "bkey long, node long, comp long, cur long, n long, outside boolean, "
                      "g int, s int, asks boolean, asked array<long>, sig binary, keys array<long>", HEAVY), "dedup-met")
    texts = texts_of(docs, met.select("node"), "node").dropDuplicates(["node"])
    cell = _cells(met.agg(F.sum("n")).first()[0] or 0, CELL_SHINGLES, "bkey", "g", "s")
    return stash(met.withColumn("cell", cell).hint("merge").join(texts, "node").groupBy("cell")
                 .applyInPandas(_each(_settle), "a long, b long").distinct(), "dedup-links")


def _answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For every b of the right, a member of its group on the left that it is linked to, the
    likeliest first."""
    found: list[tuple[int, int]] = []
    asking = dict(_groups(right, ["comp", "s", "g"]))
    for key, members in _groups(left, ["lc", "ls", "lg"]):
        if key in asking:
            b, texts = asking[key]["b"].tolist(), asking[key]["right_text"].tolist()
            a, sets = members["la"].tolist(), shingle_sets(members["left_text"])
            part = np.cumsum([len(s) for s in sets]) // (HEAVY // 2)
            for i in np.unique(part):
                at = np.flatnonzero(part == i)
                found += _linked_to([a[k] for k in at], [sets[k] for k in at], b, texts)
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _linked_to(a: list[int], sets: list[np.ndarray], b: list[int], texts: list[str]) -> Iterator[tuple[int, int]]:
    """For every ``b``, the likeliest of ``a`` that it is linked to."""
    windows = _windows()
    sigs = np.stack([signature(s, windows).astype(np.uint8) for s in sets])
    size = np.array([len(s) for s in sets])
    known, number = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(number, np.cumsum(size)[:-1])
    mark = np.zeros(len(known), dtype=bool)
    for start in range(0, len(b), MORE):
        for who, mine in zip(b[start: start + MORE], shingle_sets(texts[start: start + MORE])):
            n = len(mine)
            agree = _agreement(signature(mine, windows).astype(np.uint8)[None], sigs)[0].astype(np.int64)
            agree[100 * np.minimum(size, n) < PERCENT * np.maximum(size, n)] = 0
            at = np.argsort(-agree, kind="stable")[: np.count_nonzero(agree >= AGREE)]
            if not len(at):
                continue
            there = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            there = there[known[there] == mine]
            mark[there] = True
            for part in (at[k: k + MORE] for k in range(0, len(at), MORE)):
                both = _shared(mark, [own[j] for j in part])
                linked = part[(both > 0) & (100 * both >= PERCENT * (n + size[part] - both))]
                if len(linked):
                    yield a[linked[0]], who
                    break
            mark[there] = False


def answer(asks: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of nodes b with the components they ask (b, comp), one at least where
    there is one.  Members and askers meet in blocks of ``SIDE``."""
    comps = asks.groupBy("comp").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("groups"))
    inside = (roots.join(comps.select(F.col("comp").alias("root")), "root").select(F.col("root").alias("comp"), F.col("node").alias("a"))
              .unionByName(comps.select("comp", F.col("comp").alias("a"))))
    plan = stash(inside.groupBy("comp").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("salts")).join(comps, "comp"), "dedup-plan")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    inside = stash(inside, "dedup-inside")
    cell = functools.partial(_cells, inside.count(), CELL_PAIRS)
    left = (inside.join(plan, "comp").hint("merge").join(texts_of(docs, inside.select("a"), "a"), "a")
            .select(F.col("comp").alias("lc"), deal("a", "salts").alias("ls"), upto("groups").alias("lg"), F.col("a").alias("la"), F.col("text").alias("left_text"))
            .select("*", cell("lc", "ls", "lg")))
    right = (asks.join(plan, "comp").hint("merge").join(texts_of(docs, asks.select("b"), "b"), "b")
             .select("comp", upto("salts").alias("s"), deal("b", "groups").alias("g"), "b", F.col("text").alias("right_text"))
             .select("*", cell("comp", "s", "g")))
    return stash(left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(_answer, "a long, b long").distinct(), "dedup-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of near-duplicate rows of ``docs`` (doc_id, text; others are not read).

    Returns doc_id, n_shingles, component_id, kept, row (``row_id``) and component (a number per
    component) for every row.  Documents
    with 100 * intersection >= 75 * union are linked; component_id is the smallest doc_id that
    can be reached and kept is doc_id = component_id.  A text that is null or has no word
    is linked with nothing.  Rows that repeat a doc_id are judged by their own text each: the
    sets are the nodes, not the ids.  A row without doc_id takes no part: component_id is null
    and kept true.  Texts of any length are whole sets of 8 bytes a shingle, one in a worker
    at a time but where they are verified (``SIDE`` texts).  An empty table gives no rows.
    """
    sigs = stash(docs.select(row_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(
        _signatures, "row long, doc_id long, n_shingles long, digest binary, keys array<long>, sig binary"), "dedup-sigs")
    docs = docs.where("doc_id IS NOT NULL")
    real = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = stash(real.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "dedup-first")
    nodes = stash(real.join(first, (real["digest"] == first["digest"]) & (real["row"] == first["node"]), "left_semi")
                  .dropDuplicates(["row"])
                  .select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "keys", "sig"), "dedup-nodes")
    bands = nodes.select("node", "n", F.explode("keys").alias("bkey"))
    buckets = bands.groupBy("bkey").agg(F.min(F.struct("node", "n")).alias("p"), F.count("*").alias("size")).where("size > 1")
    members = stash(bands.join(buckets, "bkey").select("bkey", "node", "n", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), "size"), "dedup-members")
    star = stash(members.where((F.col("pivot") != F.col("node")) & (100 * F.least("n", "pn") >= PERCENT * F.greatest("n", "pn")))
                 .select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "dedup-star")
    # the smallest pivot first; another pivot only where that did not join the two
    roots = components(verify(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), docs))
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = star.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    roots = merge(roots, verify(apart.select("a", "b"), docs))
    # what is still apart asks one component, which mostly settles it; who may be linked to more meets them all
    labelled = (members.where("size > 2").select("bkey", "node", "n").join(roots, "node", "left")
                .select("bkey", "node", F.coalesce("root", "node").alias("comp"), "n", F.lit(None).cast("int").alias("band"), F.lit(-1).alias("last")))
    asks = _asks(labelled.withColumn("cur", F.col("comp")), nodes, SPLITS, ASKED, None)
    if not asks.isEmpty():
        roots = merge(roots, answer(asks.select("b", "comp"), roots, docs))
        asked = stash(asks.groupBy(F.col("b").alias("node")).agg(F.collect_set("comp").alias("asked"), F.bool_or("more").alias("more"))
                      .where("more").drop("more"), "dedup-asked")
        if not asked.isEmpty():
            by_now = roots.select(F.col("node").alias("comp"), F.col("root").alias("cur"))
            rows = labelled.join(by_now, "comp", "left").withColumn("cur", F.coalesce("cur", "comp"))
            roots = merge(roots, settle(rows, nodes, asked, docs))
    named = first.join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("comp"))
    named = named.join(least, "root").select("digest", "comp", "root")
    out = sigs.select("row", "doc_id", "n_shingles", "digest").join(named, "digest", "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("comp", "doc_id"))
    return (out.withColumn("component_id", comp.cast("long"))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "row",
                    F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one row of each component: the one of
    the smallest doc_id, of rows that share it the one of the smallest ``row_id``.  Of rows
    equal in doc_id and text one stays, whichever, null ids and empty texts included; a row
    without doc_id or without a word is otherwise a component of its own.
    """
    found = stash(near_duplicates(docs).select(F.coalesce("component", "row").alias("group"), "row", "kept"), "dedup-found")
    groups = found.groupBy("group").agg(F.min(F.struct(~F.col("kept"), "row")).alias("best"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    lost = found.join(groups.where("lo <> hi"), "group").where("row <> best.row").select(F.col("row").alias("_lost")).distinct()
    many = found.groupBy(F.col("row").alias("_many")).agg(F.count("*").alias("n")).where("n > 1").select("_many")
    left = docs.withColumn("_row", row_id()).join(lost, F.col("_row") == F.col("_lost"), "left_anti")
    once = left.join(many, F.col("_row") == F.col("_many"), "left_anti")
    again = left.join(many, F.col("_row") == F.col("_many"), "left_semi").dropDuplicates(["_row"])  # only literal copies are shuffled by row
    return once.unionByName(again).drop("_row")
