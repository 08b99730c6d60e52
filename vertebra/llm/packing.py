"""Best-fit packing of tokenised documents by large-item matching.

Items longer than a third of the capacity fit a sequence at most twice, so they are paired
first: the longest with the longest partner that still fits (greedy matching).  The smaller
ones follow by descending length, each into the smallest gap that holds it; where none does, a
new sequence is opened.

Items of one length are interchangeable, so all this runs on the *histogram of lengths*
(``capacity`` numbers at most, whatever the table's size).  Sequences of the same gap are kept
as runs of consecutive numbers, and the plan says of each length which ranks go to which run:
``plan`` splits a run at most twice per length, and a sequence holds fewer than
sqrt(2 * capacity) different lengths, so the plan is bounded by the capacity too.  An item
finds its place from its length and its rank among the items of that length, which is the
number it got in the task that tokenised it plus the counts of the tasks before.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stash

CAPACITY, END = 4096, 1
#: Pre-tokens and words whose ids a worker keeps, and characters of text that it looks at in one go.
_TOKENS, _WORDS, _SLICE = 700_000, 200_000, 1 << 20
#: Characters of texts encoded together; pre-tokens or words merged in one call; rows and ids of an Arrow batch given out.
_UNIT, _CALL, _ROWS, _IDS = 4_000_000, 4000, 4096, 1_000_000
_BLANK = re.compile("[ \t\n\r\x0b\x0c]")
#: Texts with none of these are made of blanks and of letters, digits and signs up to U+017F that
#: are their own normal form and whose lower case is one character; others go by whole words.
_UNUSUAL = "[^\n\t\r !-~\u00a1-\u012f\u0131-\u017f]|<\\|"

PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"


class Kept(dict):
    """The ids of the entries added last, ``most`` at the utmost."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def add(self, new: dict[str, bytes]) -> None:
        over = len(self) + len(new) - self.most
        if over > 0:
            for k in list(itertools.islice(self, max(len(self) // 8, over))):
                del self[k]
        if len(new) <= self.most:
            self.update(new)


class Encoder:
    """Ids (little-endian unsigned 32-bit integers) of texts by a vocabulary of words.

    Its normaliser and pre-tokeniser never look across white space and drop it, so a text's ids
    are those of its words, cut at ASCII white space, one after the other.  Where a text holds
    usual characters only (``_UNUSUAL``), its lower case is cut into pre-tokens by the
    vocabulary's own pattern, and the library merges those, many in one call: the last id of a
    pre-token, and no other, ends a word.  Each distinct pre-token or word of a batch is looked
    up among those seen last first.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.library.model)  # of pre-tokens, one in a line
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        spec = json.loads(self.library.to_str())
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.tokens, self.words = Kept(_TOKENS), Kept(_WORDS)

    def _merge(self, tokens: list[str]) -> list[bytes]:
        ids = np.array(self.merges.encode_batch_fast(["\n".join(tokens)], add_special_tokens=False)[0].ids, dtype="<u4")
        raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(ends) != len(tokens):
            raise ValueError("a pre-token that does not end a word")
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, texts: pa.Array, kept: Kept, find: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of each text, its parts being separated by white space; ``find`` has those of parts not ``kept``."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [kept.get(w) if w else b"" for w in names]  # a leading blank makes an empty part
        fresh = [w for w, found in zip(names, ids) if found is None]
        if fresh:
            new: dict[str, bytes] = {}
            for i in range(0, len(fresh), _CALL):
                new.update(zip(fresh[i: i + _CALL], find(fresh[i: i + _CALL])))
            ids = [new[w] if found is None else found for w, found in zip(names, ids)]
            kept.add(new)
        data = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset: data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
        raw = memoryview(data.buffers()[2] or b"")
        edges = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [bytes(raw[a:b]) for a, b in zip(edges, edges[1:])]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (none null)."""
        out: list[bytes] = [b""] * len(texts)
        unusual = pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False).astype(bool)
        usual = np.flatnonzero(~unusual)
        if len(usual):
            cut = pc.replace_substring_regex(pc.utf8_lower(texts.take(pa.array(usual))), self.pattern, "\\0 ")
            for i, ids in zip(usual, self._joined(cut, self.tokens, self._merge)):
                out[i] = ids
        rest = np.flatnonzero(unusual)
        if len(rest):
            for i, ids in zip(rest, self._joined(texts.take(pa.array(rest)), self.words, self._whole)):
                out[i] = ids
        return out

    def slices(self, text: str) -> Iterator[bytes]:
        """The ids of one text, bit by bit."""
        at = 0
        while at < len(text):
            blank = _BLANK.search(text, at + _SLICE) if len(text) - at > _SLICE else None
            end = blank.start() if blank else len(text)
            yield self.encode(pa.array([text[at:end]]))[0]
            at = end


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(slices: Iterable[bytes], capacity: int, end: int) -> Iterator[bytes]:
    """Pieces of ``capacity`` ids of the ids in ``slices`` and ``end``; the last may be shorter."""
    held, size = b"", 4 * capacity
    for more in itertools.chain(slices, [np.array([end], "<u4").tobytes()]):
        held += more
        whole = len(held) // size * size
        for i in range(0, whole, size):
            yield held[i: i + size]
        held = held[whole:]
    if held:
        yield held


def _tokenise(path: str, capacity: int, end: int):
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        nth: Counter[int] = Counter()
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch, texts in pieces(batches, most=_UNIT):
            short = pa.array([t if t is not None and len(t) <= _SLICE else "" for t in texts], pa.string())
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, text, whole in zip(doc_ids, texts, enc.encode(short)):
                for k, ids in enumerate(cut([whole] if len(text or "") <= _SLICE else enc.slices(text), capacity, end)):
                    n = len(ids) // 4
                    rows.append((doc_id, k, k * capacity, n, ids, part, nth[n]))
                    nth[n] += 1
                    held += n
                    if len(rows) >= _ROWS or held >= _IDS:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    return run


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of the rows of ``docs`` (doc_id, text; others are not read), ready to be packed:
    doc_id, piece (from 0), start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit integers), part and nth (task, and number among its pieces of that length).

    A document's ids are those of ``path`` without special tokens, then ``end``; only longer
    ones than ``capacity`` are cut.  A null text counts as empty (one id), a null doc_id is
    carried along, repeated rows are documents of their own, texts of any length are encoded in
    slices; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenise(path, capacity, end), PIECES)


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where the items of each length go, and the number of sequences.

    Rows (length, first rank, sequences, copies, first sequence, offset): rank ``first + i`` of
    the length goes to sequence ``first sequence + i // copies``, at ``offset + i % copies * length``.
    """
    left = {n: c for n, c in counts.items() if c}
    ranks: Counter[int] = Counter()
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, sequences)
    opened = 0

    def put(length: int, first: int, sequences: int, copies: int, gap: int) -> None:
        rows.append((length, ranks[length], sequences, copies, first, capacity - gap))
        ranks[length] += sequences * copies
        left[length] -= sequences * copies

    # the large items: pairs, longest first, each with the longest partner that fits
    large = sorted((n for n in left if 3 * n > capacity))
    for n in reversed(large):
        for other in reversed(large[: bisect.bisect_right(large, min(n, capacity - n))]):
            pairs = left[n] // 2 if other == n else min(left[n], left[other])
            if pairs:
                put(n, opened, pairs, 2 if other == n else 1, capacity)
                if other != n:
                    put(other, opened, pairs, 1, capacity - n)
                gaps[capacity - n - other].append((opened, pairs))
                opened += pairs
            if not left[n]:
                break
        if left[n]:
            gaps[capacity - n].append((opened, left[n]))
            put(n, opened, opened_now := left[n], 1, capacity)
            opened += opened_now
    # the smaller ones: into the smallest gap that holds them, else into new sequences
    order = sorted(g for g in gaps if g)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect.bisect_left(order, n)
            if i < len(order):
                gap = order.pop(i)
                runs = gaps.pop(gap)
            else:
                gap, runs = capacity, [(opened, -(-left[n] // (capacity // n)))]
                opened += runs[0][1]
            most = gap // n
            made: list[tuple[int, int, int]] = []  # gap left, first sequence, sequences
            while runs and left[n]:
                first, sequences = runs.pop()
                full = min(sequences, left[n] // most)
                if full:
                    put(n, first, full, most, gap)
                    made.append((gap - most * n, first, full))
                if full < sequences and left[n]:
                    some = left[n]  # fewer than fill one sequence
                    put(n, first + full, 1, some, gap)
                    made.append((gap - some * n, first + full, 1))
                    full += 1
                if full < sequences:
                    runs.append((first + full, sequences - full))
            for g, first, sequences in [*made, *((gap, *r) for r in runs)]:
                if g:
                    if g not in gaps:
                        bisect.insort(order, g)
                    gaps[g].append((first, sequences))
    return np.array(rows, dtype=np.int64).reshape(-1, 6), opened


def _place(rows: np.ndarray):
    """Adds sequence_id and offset by length and rank."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    length, first, _, copies, sequence, offset = rows.T
    starts = np.searchsorted(length, np.arange(length.max() + 2 if len(length) else 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(False) for c in ("length", "_rank"))
            at = np.zeros(len(own), dtype=np.int64)
            for n in np.unique(own):
                mine = own == n
                a, b = starts[n], starts[n + 1]
                at[mine] = a + np.searchsorted(first[a:b], rank[mine], side="right") - 1
            i = rank - first[at]
            yield (batch.append_column("sequence_id", pa.array(sequence[at] + i // copies[at]))
                   .append_column("offset", pa.array(offset[at] + i % copies[at] * own)))

    return run


def pack(stored: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and place of every row of ``stored``, a *written* table with the columns length
    (1 to ``capacity``), part and nth of ``tokenise``; other columns are kept.

    Adds sequence_id (from 0, gapless) and offset (gapless from 0 in each sequence).
    """
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``capacity`` rows at most
    rows, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (stored.groupBy("length", "part").agg(F.count("*").alias("_n"))
             .select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    ranked = stored.join(parts, ["length", "part"]).withColumn("_rank", F.col("_before") + F.col("nth")).drop("_before")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(_place(rows), f"{fields}, sequence_id long, offset long").drop("_rank", "part", "nth")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of the whole sequences, from ``pack`` rows with ``ids``."""
    joined = F.expr("reduce(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids), cast('' as binary), (a, b) -> concat(a, b))")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def op12(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row
    of ``docs``; awkward rows as in ``tokenise``."""
    found = tokenise(docs, public_tokenizers.path("word_bpe_49k.json"))
    stored = stash(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pack-pieces")
    return pack(stored).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
