"""Scoring texts by a probabilistic suffix tree over words.

A state is a context of up to ``depth`` words.  A sequence of words is in the tree if the
training documents hold it ``LEAST`` times, at any size of the corpus.

A context stays as a state if its successors diverge from those of its longest suffix state:
its count times the Kullback-Leibler divergence must exceed half the log of the corpus size
per explicit successor.  A state gives a frequent successor its discounted share and passes
the rest on to its suffix state; the root is the smoothed word distribution.  Each word is
scored by the longest suffix of its history that is a state.

Such a score is a sum over the sequences of a document: every word adds its log share in the
root, every state what it passes on, and every sequence after a state the difference to that.

The tree is a set of tables that grow with the corpus; nothing of it is broadcast or gathered.

1.  Texts are split into words once and stored as chunks of numbered words, in buckets.
2.  A chunk sends the hashes of its different sequences, dealt by range into slots.  A slot
    adds up the counts and answers with a bit for each sequence that is frequent, with another
    one to the chunk that is to put it into the table, and with the ranks of the frequent ones
    in the slot, a byte or two each.  Words and pairs go first; then, word by word, only
    sequences of which all but the last and all but the first word are frequent.
3.  Chunks put the frequent sequences into the table: number (slot and rank), context, suffix
    and counts.
4.  Level by level, joins on the suffix and sums by context give states and weights.
5.  The weights go to the slots, where the ranks that each chunk was told still are: no key is
    sent again.  A chunk gets the weights in the order of its sequences and adds them up per
    document.

A key is a hash of 20 bits more than it takes to number all tokens (62 at most), so that about
one key in a million is shared by chance, at any size; words have 64 bits.

Defined cases: null text is only its end; a null doc_id counts as an empty one when the fold
is chosen, so it is held out; repeated rows each count and are scored; without training
documents all words are unknown; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.llm.common import grouped, shared_folder, text_of

END = "\n"  # no word holds a line end
DISCOUNT = 0.5
#: How often the training documents hold a sequence of the tree.
LEAST = 2
#: Tokens of a chunk, bytes of text that are split at a time, and keys of a slot.
CHUNK_TOKENS, SPLIT_BYTES, SLOT_KEYS = 1_000_000, 4 << 20, 1_000_000
#: Bits of a rank in a slot; a sequence's number has the slot above them.
RANK_BITS = 24
#: With this setting shuffle files go when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


# The tree of a small corpus on one machine, to which the tests hold the tables.


@dataclass
class Level:
    """Frequent sequences of one more word than ``depth`` of their context: key = context * width + word, sorted."""

    keys: np.ndarray
    counts: np.ndarray
    log_p: np.ndarray = field(default_factory=lambda: np.empty(0))  # per sequence, its last word after its context
    state: np.ndarray = field(default_factory=lambda: np.empty(0, bool))  # per context
    log_rest: np.ndarray = field(default_factory=lambda: np.empty(0))  # per context, what it passes on


@dataclass
class Tree:
    words: list[bytes]
    counts: np.ndarray
    total: int
    vocabulary: int
    levels: list[Level] = field(default_factory=list)

    @property
    def width(self) -> int:
        return max(1, len(self.words))

    def root(self) -> np.ndarray:
        return np.log10((self.counts + 0.1) / (self.total + 0.1 * (self.vocabulary + 1)))


def _index(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _passed_on(tree: Tree, context: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of ``word`` after the states that are suffixes of ``context``, a sequence of ``depth`` words, without itself."""
    value = tree.root()[word]
    suffix = _suffixes(tree, depth)
    chain = []
    for d in range(depth - 1, 0, -1):
        context = suffix[d + 1][context]
        chain.append((d, context))
    for d, at in reversed(chain):
        level = tree.levels[d - 1]
        k = _index(level.keys, at * tree.width + word)
        value = np.where(level.state[at], np.where(k >= 0, level.log_p[k], level.log_rest[at] + value), value)
    return value


def _suffixes(tree: Tree, depth: int) -> dict[int, np.ndarray]:
    """For sequences of d words, the place of their last d - 1 words."""
    found = {1: np.zeros(len(tree.words), dtype=np.int64)}
    for d in range(2, depth + 1):
        keys = tree.levels[d - 2].keys
        head, word = keys // tree.width, keys % tree.width
        found[d] = word if d == 2 else _index(tree.levels[d - 3].keys, found[d - 1][head] * tree.width + word)
    return found


def add_level(tree: Tree, keys: np.ndarray, counts: np.ndarray) -> None:
    """Tests the contexts of the counted sequences and smooths those that stay."""
    depth = len(tree.levels) + 1
    context, word = keys // tree.width, keys % tree.width
    seen = tree.counts if depth == 1 else tree.levels[-1].counts
    n = len(seen)
    p, log_q = counts / seen[context], _passed_on(tree, context, word, depth)
    q = 10**log_q
    rest_p = np.clip(1 - np.bincount(context, p, n), 0, 1)
    rest_q = np.clip(1 - np.bincount(context, q, n), 1e-12, 1)
    divergence = np.bincount(context, p * np.log(p / q), n) + np.where(rest_p > 0, rest_p * np.log(np.maximum(rest_p, 1e-12) / rest_q), 0)
    explicit = np.bincount(context, minlength=n)
    state = (explicit > 0) & (seen * divergence > 0.5 * math.log(max(tree.total, 2)) * explicit)
    share = (counts - DISCOUNT) / seen[context]
    rest = 1 - np.bincount(context, share, n)
    level = Level(keys, counts, np.log10(share + rest[context] * q), state, np.log10(np.maximum(rest, 1e-12)))
    tree.levels.append(level)


# The tree as tables.


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers, the lowest bytes of all first, without the high bytes that none has."""
    most = int(values.max()) if len(values) else 0
    planes = max(1, -(-most.bit_length() // 8))
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), dtype=np.uint8)
    if n:
        wide[:, : len(blob) // n] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, n).T
    return wide.view("<u8").ravel()


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n).astype(bool)


def _ranks(ranks: np.ndarray) -> bytes:
    """Sorted ranks by the steps from one to the next."""
    return _packed(np.diff(ranks, prepend=0))


def _ranks_of(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(blob, n).astype(np.int64))


def _joined(context: np.ndarray, suffix: np.ndarray, bits: int = 64) -> np.ndarray:
    """Key of a sequence from the keys of all but its last and all but its first word."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + (suffix ^ (suffix >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - bits)


def _places(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted different ones."""
    return np.unique(keys, return_inverse=True)[1]


@dataclass(frozen=True)
class Plan:
    """``bits`` of a key, ranges of keys, and words of a context."""

    bits: int
    slots: int
    depth: int

    def width(self, level: int) -> int:
        return 64 if level == 1 else self.bits

    def slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys >> np.uint64(self.width(level) - 24)).astype(np.int64) * self.slots) >> 24


class _Open:
    """A chunk under way: documents as numbers of its own words; the end has number 0."""

    def __init__(self):
        self.number: dict[str, int] = {END: 0}
        self.tokens: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.doc_ids: list = []
        self.size = 0

    def add(self, doc_ids: pa.Array, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # the six blanks
        words, offsets = lists.values, lists.offsets.to_numpy()
        filled = pc.greater(pc.binary_length(words), 0)
        before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
        lengths = before[offsets[1:]] - before[offsets[:-1]] + 1
        encoded = words.filter(filled).dictionary_encode()
        different = encoded.dictionary.to_pylist()
        own = np.fromiter((self.number.setdefault(w, len(self.number)) for w in different), dtype=np.int64, count=len(different))
        tokens = np.zeros(int(lengths.sum()), dtype=np.int64)
        is_word = np.ones(len(tokens), dtype=bool)
        is_word[np.cumsum(lengths) - 1] = False
        tokens[is_word] = own[encoded.indices.to_numpy(zero_copy_only=False)]
        self.tokens.append(tokens)
        self.lengths.append(lengths)
        self.doc_ids += doc_ids.to_pylist()
        self.size += len(tokens)

    def row(self, kind: pa.DataType, chunk: int, held: bool) -> pa.RecordBatch:
        tokens, lengths = np.concatenate(self.tokens), np.concatenate(self.lengths)
        order = np.argsort(-np.bincount(tokens, minlength=len(self.number)), kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.number], dtype="<u8")[order]
        numbers = pa.compress(_packed(place[tokens]), codec="zstd", asbytes=True)
        columns = [pa.array([chunk]), pa.array([held]), pa.array([len(tokens)]), pa.array([hashes.tobytes()]), pa.array([numbers]), pa.array([_packed(lengths)]), pa.array([self.doc_ids], pa.list_(kind))]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "held", "n_tokens", "words", "numbers", "lengths", "doc_ids"])


def _split(kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, chunks = TaskContext.get().partitionId() << 33, {False: _Open(), True: _Open()}
        for batch in batches:
            for held in (False, True):
                part = batch.filter(pc.equal(batch.column("held"), held))
                bounds = np.cumsum(pc.binary_length(part.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // SPLIT_BYTES
                for at in np.flatnonzero(np.diff(bounds, prepend=-1)).tolist():
                    some = part.slice(at, int(np.searchsorted(bounds, bounds[at], "right")) - at)
                    chunks[held].add(some.column("doc_id"), some.column("text"))
                    if chunks[held].size >= CHUNK_TOKENS:
                        yield chunks[held].row(kind, chunk, held)
                        chunk, chunks[held] = chunk + 1, _Open()
        for held, rest in chunks.items():
            if rest.size:
                yield rest.row(kind, chunk, held)
                chunk += 1
        chunks.clear()
        pa.default_memory_pool().release_unused()

    return run


class Known:
    """What the slots answered a chunk, by level, in the order of its sorted different keys; unpacked when it is asked for."""

    def __init__(self, answers: list[dict]):
        self.answers: dict[int, list[dict]] = {}
        for a in sorted(answers, key=lambda a: a["slot"]):
            self.answers.setdefault(a["level"], []).append(a)

    def _masks(self, level: int, name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=bool), *(_mask(a[name], a["n"]) for a in self.answers.get(level, ()))])

    def often(self, level: int) -> np.ndarray:
        return self._masks(level, "often")

    def own(self, level: int) -> np.ndarray:
        return self._masks(level, "own")

    def totals(self, level: int) -> np.ndarray:
        """The counts of words, and of the frequent ones of the longer sequences."""
        some = self.answers.get(level, ())
        if level == 1:
            return np.concatenate([np.zeros(0, dtype=np.int64), *(_unpacked(a["totals"], a["n"]) for a in some)]).astype(np.int64)
        often = self.often(level)
        found = np.zeros(len(often), dtype=np.int64)
        found[often] = np.concatenate([np.zeros(0, dtype=np.int64), *(_unpacked(a["totals"], a["n_often"]) for a in some)])
        return found

    def numbers(self, level: int) -> np.ndarray:
        """The numbers of the frequent ones, -1 for the others."""
        often = self.often(level)
        found = np.full(len(often), -1, dtype=np.int64)
        found[often] = np.concatenate([np.zeros(0, dtype=np.int64), *((a["slot"] << RANK_BITS) + _ranks_of(a["ranks"], a["n_often"]) for a in self.answers.get(level, ()))])
        return found


class Chunk:
    """Words and sequences of a stored chunk."""

    def __init__(self, row: dict, plan: Plan):
        self.plan, self.id, self.held, self.doc_ids = plan, row["chunk"], row["held"], row["doc_ids"]
        n = row["n_tokens"]
        self.hashes = np.frombuffer(row["words"], dtype="<u8")
        planes = max(1, -(-max(0, len(self.hashes) - 1).bit_length() // 8))
        self.numbers = _unpacked(pa.decompress(row["numbers"], decompressed_size=n * planes, codec="zstd", asbytes=True), n).astype(np.int32)
        self.lengths = _unpacked(row["lengths"], len(self.doc_ids)).astype(np.int64)
        self.document = np.repeat(np.arange(len(self.doc_ids), dtype=np.int32), self.lengths)

    def sequences(self, known: Known, last: int, told: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """level, key at each place, the places of sequences inside one document whose two parts are frequent, and where each is among the sorted different keys of these, up to the ``last`` level.

        ``told`` is the last level that the slots have answered: where sequences are is not looked up beyond it.
        """
        keys, often = self.hashes[self.numbers], None
        for level in range(2, last + 1):
            keys = _joined(keys[:-1], keys[1:], self.plan.bits)
            inside = self.document[: len(keys)] == self.document[level - 1 :]
            if often is not None:
                inside &= often[:-1] & often[1:]
            at = np.flatnonzero(inside)
            place = _places(keys[at]) if level <= told else None
            yield level, keys, at, place
            if level < last:
                often = np.zeros(len(keys), dtype=bool)
                often[at] = known.often(level)[place]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes, and the place among them of each numbered word."""
        order = np.argsort(self.hashes)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return self.hashes[order], place


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of chunks, of which only one at a time is unpacked."""
    for k in range(len(batch)):
        yield batch.slice(k, 1).to_pylist()[0]


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 512], strict=True), kinds, strict=True)], names)


_ASKED = ["slot", "chunk", "level", "held", "n", "first", "steps", "counts"]
_ASKED_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
ASKED = "slot long, chunk long, level int, held boolean, n long, first long, steps binary, counts binary"


def _by_slot(keys: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, int, bytes, int, int]]:
    """slot, the first of its keys, the steps from one to the next, and from where to where, of sorted keys."""
    starts = np.flatnonzero(np.diff(slot, prepend=-1))
    steps = np.diff(keys, prepend=np.uint64(0))
    firsts = keys[starts].astype(np.uint64).view(np.int64).tolist()
    steps[starts] = 0
    for a, b, first, where in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], firsts, slot[starts].tolist(), strict=True):
        yield where, first, _packed(steps[a:b]), a, b


def _asked(chunk: Chunk, level: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys, and their counts, by slot."""
    parts = _by_slot(keys, chunk.plan.slot(keys, level))
    yield from _rows(_ASKED, _ASKED_KINDS, [(where, chunk.id, level, chunk.held, b - a, first, steps, _packed(counts[a:b])) for where, first, steps, a, b in parts])


def _keys_of(first: int, steps: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(steps, n), dtype=np.uint64) + np.uint64(first & 0xFFFFFFFFFFFFFFFF)


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and how often each is there."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], np.diff(starts, append=len(keys))


def _ask_counts(plan: Plan, level: int) -> Callable:
    """The different sequences of ``level`` words; with those of two, the words too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                chunk = Chunk(row, plan)
                if level == 2:
                    words, place = chunk.words()
                    yield from _asked(chunk, 1, words, np.bincount(place[chunk.numbers], minlength=len(words)))
                for at_level, keys, at, _ in chunk.sequences(Known(row.get("answers") or []), level, level - 1):
                    if at_level == level:
                        yield from _asked(chunk, level, *_different(keys[at]))
        pa.default_memory_pool().release_unused()

    return run


_ANSWERS = ["chunk", "level", "slot", "n", "often", "own", "totals", "n_often", "ranks"]
_ANSWER_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
ANSWERS = "chunk long, level int, slot long, n long, often binary, own binary, totals binary, n_often long, ranks binary"


def _answer_counts(least: int) -> Callable:
    """For each blob which of its keys are frequent, which its chunk is to put into the table, the counts of the frequent ones (of words: of all) and their ranks among all frequent ones of the slot.

    A row of chunk -1 has the number of different words of the slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "slot"):
            by_level: dict[int, list[dict]] = {}
            for row in table.to_pylist():
                by_level.setdefault(row["level"], []).append(row)
            for level, blobs in by_level.items():
                blobs.sort(key=lambda row: (row["held"], row["chunk"]))
                counts = np.concatenate([np.zeros(b["n"], dtype=np.uint64) if b["held"] else _unpacked(b["counts"], b["n"]) for b in blobs])
                keys, inverse = np.unique(np.concatenate([_keys_of(b["first"], b["steps"], b["n"]) for b in blobs]), return_inverse=True)
                totals = np.bincount(inverse, counts, len(keys)).astype(np.int64)
                first = np.empty(len(keys), dtype=np.int64)
                first[inverse[::-1]] = np.arange(len(inverse))[::-1]
                often = totals >= least
                own = np.zeros(len(inverse), dtype=bool)
                own[first[often]] = True
                rank = np.cumsum(often) - 1
                if len(keys) > 1 << RANK_BITS:
                    raise ValueError(f"slot {blobs[0]['slot']} has {len(keys)} sequences, which {RANK_BITS} bits do not number")
                often, totals, rank = often[inverse], totals[inverse], rank[inverse]
                rows, a = [], 0
                for blob in blobs:
                    b = a + blob["n"]
                    wanted = totals[a:b] if level == 1 else totals[a:b][often[a:b]]
                    rows.append((blob["chunk"], level, blob["slot"], blob["n"], _bits(often[a:b]), _bits(own[a:b]), _packed(wanted), int(np.count_nonzero(often[a:b])), _ranks(rank[a:b][often[a:b]])))
                    a = b
                if level == 1:
                    rows.append((-1, 1, blobs[0]["slot"], int(np.count_nonzero(np.bincount(inverse, counts))), None, None, None, 0, None))
                yield from _rows(_ANSWERS, _ANSWER_KINDS, rows)
        pa.default_memory_pool().release_unused()

    return run


TABLE = "level int, key long, context long, suffix long, n long, seen long, suffix_n long"


def _put(plan: Plan) -> Callable:
    """The sequences that a chunk is to put into the table, by their numbers; the count of the suffix only for pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                chunk, known = Chunk(row, plan), Known(row["answers"])
                word = chunk.words()[1][chunk.numbers]
                shorter, total = known.numbers(1)[word], known.totals(1)[word]
                for level, keys, at, place in chunk.sequences(known, plan.depth + 1, plan.depth + 1):
                    own, totals, numbers = known.own(level), known.totals(level), known.numbers(level)
                    first = np.empty(len(own), dtype=np.int64)
                    first[place[::-1]] = at[::-1]
                    number, n, here = numbers[own], totals[own], first[own]
                    real = (total[here] >= n) & (total[here + 1] >= n)  # not so where sequences share a key by chance
                    number, n, here = number[real], n[real], here[real]
                    suffix_n = pa.array(total[here + 1]) if level == 2 else pa.nulls(len(here), pa.int64())
                    columns = [number, shorter[here], shorter[here + 1], n, total[here]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), level, dtype=np.int32)), *map(pa.array, columns), suffix_n], ["level", "key", "context", "suffix", "n", "seen", "suffix_n"])
                    shorter, total = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
                    shorter[at], total[at] = numbers[place], totals[place]
        pa.default_memory_pool().release_unused()

    return run


GIVEN = "slot long, level int, n_often long, ranks binary, weights binary"


def _give_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of weights as blobs by slot: sorted ranks, repeated where a sequence has two weights, and a weight for each."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        levels, numbers, weights = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("level", "key", "weight"))
        rows = []
        for level in np.unique(levels).tolist():
            mine = np.flatnonzero(levels == level)
            mine = mine[np.argsort(numbers[mine])]
            slot, rank, weight = numbers[mine] >> RANK_BITS, numbers[mine] & ((1 << RANK_BITS) - 1), weights[mine].astype("<f4")
            starts = np.flatnonzero(np.diff(slot, prepend=-1)).tolist()
            rows += [(int(slot[a]), level, b - a, _ranks(rank[a:b]), weight[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(mine)], strict=True)]
        yield from _rows(["slot", "level", "n_often", "ranks", "weights"], [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], rows)

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK_TOKENS:
            yield from flush()
            held = []
    if held:
        yield from flush()


WEIGHTS = "chunk long, level int, slot long, weights binary"


def _answer_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of the ranks that each chunk was told."""
    for table in grouped(batches, "slot"):
        given: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        told = []
        for row in table.to_pylist():
            if row["weights"] is None:
                told.append(row)
            else:
                given.setdefault(row["level"], []).append((_ranks_of(row["ranks"], row["n_often"]), np.frombuffer(row["weights"], dtype="<f4")))
        sums = {level: np.bincount(np.concatenate([r for r, _ in parts]), np.concatenate([w for _, w in parts])).astype("<f4") for level, parts in given.items()}
        rows = []
        for row in told:
            ranks, weights = _ranks_of(row["ranks"], row["n_often"]), sums.get(row["level"], np.zeros(0, dtype="<f4"))
            found = np.zeros(len(ranks), dtype="<f4")
            known = int(np.searchsorted(ranks, len(weights)))  # the ranks above the highest one that is given have no weight
            found[:known] = weights[ranks[:known]]
            rows.append((row["chunk"], row["level"], row["slot"], found.tobytes()))
        yield from _rows(["chunk", "level", "slot", "weights"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()], rows)
    pa.default_memory_pool().release_unused()


def _score(plan: Plan, kind: pa.DataType, total: int, vocabulary: int) -> Callable:
    floor = total + 0.1 * (vocabulary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                chunk, known = Chunk(row, plan), Known(row["answers"])
                weights: dict[int, list[dict]] = {}
                for w in sorted(row["weights"] or [], key=lambda w: w["slot"]):
                    weights.setdefault(w["level"], []).append(np.frombuffer(w["weights"], dtype="<f4"))
                size = len(chunk.doc_ids)

                def sums(level: int, document: np.ndarray, place: np.ndarray) -> np.ndarray:
                    often = known.often(level)  # noqa: B023
                    value = np.zeros(len(often))
                    if level in weights:  # noqa: B023
                        value[often] = np.concatenate(weights[level])  # noqa: B023
                    return np.bincount(document, value[place], size)  # noqa: B023

                place = chunk.words()[1][chunk.numbers]
                count = known.totals(1)[place]
                base = np.bincount(chunk.document, np.log10((count + 0.1) / floor), size)
                score = base + sums(1, chunk.document, place)
                for level, _, at, where in chunk.sequences(known, plan.depth + 1, plan.depth + 1):
                    if len(at):
                        score += sums(level, chunk.document[at], where)
                n_known = np.bincount(chunk.document, count > 0, size).astype(np.int64)
                columns = [pa.array(chunk.doc_ids, kind), pa.array([chunk.held] * size, pa.bool_()), pa.array(chunk.lengths), pa.array(n_known), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        pa.default_memory_pool().release_unused()

    return run


def _stored(df: DataFrame, name: str, *parts: str) -> tuple[DataFrame, str]:
    """The same rows in columns in the shared folder, smaller than a checkpoint, in folders by ``parts``, and their place."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of our own that nothing reads any more."""
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _chunk_table(docs: DataFrame, kind: pa.DataType, buckets: int) -> DataFrame:
    """The words of all documents in chunks, in buckets by chunk, so that answers come to a chunk without moving it."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out().alias("held"), text_of().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_split(kind), f"chunk long, held boolean, n_tokens long, words binary, numbers binary, lengths binary, doc_ids array<{id_type}>")
    name = f"chunks_{uuid.uuid4().hex}"
    found.write.format("parquet").option("path", shared_folder(spark, "chunks")).option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return table


def _met(chunks: DataFrame, **answers: DataFrame) -> DataFrame:
    """Chunks with all answers to them, a few bits or bytes for each of their sequences."""
    for name, table in answers.items():
        fields = sorted({*table.columns} - {"chunk"})
        chunks = chunks.join(table.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct(*fields)).alias(name)), "chunk", "left")
    return chunks


def _weights(counted: DataFrame, place: str, plan: Plan, total: int, vocabulary: int) -> tuple[DataFrame, list[str]]:
    """level, key, weight: what a sequence adds to a score, as the last word after its context and as a state; and where they are stored.

    ``place`` has ``counted`` in folders by level, which are deleted one after the other.
    """
    spark, values, parts, kept = counted.sparkSession, None, [], []
    for level in range(2, plan.depth + 2):
        last, own = level == plan.depth + 1, f"{place}/level={level}"
        found = counted.where(F.col("level") == level).drop("level")
        if values is None:
            found = found.withColumn("log_q", F.log10((F.col("suffix_n") + 0.1) / (total + 0.1 * (vocabulary + 1)))).drop("suffix", "suffix_n")
        else:
            found = found.join(values.select(F.col("key").alias("suffix"), F.col("v").alias("log_q")), "suffix").drop("suffix", "suffix_n")
            found, path = _stored(found, "sequences")
            weights, light = _stored(values.where("weight IS NOT NULL").select("key", "weight"), "values")
            _discard(spark, own, heavy)
            own = path
            kept.append(light)
            parts.append(weights.select(F.lit(level - 1).alias("level"), "key", "weight"))
        p, q, share = F.col("n") / F.col("seen"), F.pow(F.lit(10.0), "log_q"), (F.col("n") - DISCOUNT) / F.col("seen")
        sums = found.groupBy("context", "seen").agg(F.sum(p).alias("p"), F.sum(q).alias("q"), F.sum(p * F.log(p / q)).alias("d"), F.count("*").alias("explicit"), F.sum(share).alias("share"))
        rest_p, rest_q = F.greatest(F.lit(0.0), 1 - F.col("p")), F.greatest(F.lit(1e-12), 1 - F.col("q"))
        divergence = F.col("d") + F.when(rest_p > 0, rest_p * F.log(F.greatest(rest_p, F.lit(1e-12)) / rest_q)).otherwise(0.0)
        is_state = F.col("seen") * divergence > 0.5 * math.log(max(total, 2)) * F.col("explicit")
        states, path = _stored(sums.where(is_state).select("context", F.log10(F.greatest(1 - F.col("share"), F.lit(1e-12))).alias("log_rest")), "states")
        kept.append(path)
        parts.append(states.select(F.lit(level - 1).alias("level"), F.col("context").alias("key"), F.col("log_rest").alias("weight")))
        passed = F.log10(share + F.pow(F.lit(10.0), "log_rest") * q)
        weight = (passed - F.col("log_q") - F.col("log_rest")).alias("weight")
        if last:
            values, path = _stored(found.join(states, "context").select("key", weight), "values")
            kept.append(path)
            parts.append(values.select(F.lit(level).alias("level"), "key", "weight"))
        else:
            values, heavy = _stored(found.join(states, "context", "left").select("key", F.coalesce(passed, "log_q").alias("v"), weight), "values")
        _discard(spark, own)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found, kept


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that end here leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def score_documents(docs: DataFrame, depth: int = 2, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type, kind = docs.schema["doc_id"].dataType.simpleString(), docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    with _cleaned(spark):
        chunks = _chunk_table(docs, kind, partitions)
        tokens, total = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("held"), F.col("n_tokens"))), F.lit(0))).first()
        plan = Plan(min(62, max(1, tokens).bit_length() + 20), max(1, -(-2 * tokens // SLOT_KEYS)), depth)
        dealt = max(partitions, plan.slots // 8)
        by_slot = lambda df: df.repartition(dealt, "slot").sortWithinPartitions("slot")
        met, answers = chunks, None
        for level in range(2, depth + 2):
            told, _ = _stored(by_slot(met.mapInArrow(_ask_counts(plan, level), ASKED)).mapInArrow(_answer_counts(least), ANSWERS), "answers")
            answers = told if answers is None else answers.unionByName(told)
            met = _met(chunks, answers=answers.select("chunk", "level", "slot", "n", "often"))
        vocabulary = answers.where("chunk < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        counted, path = _stored(_met(chunks, answers=answers).mapInArrow(_put(plan), TABLE), "counted", "level")
        weights, kept = _weights(counted, path, plan, total, vocabulary)
        ranks = answers.where("n_often > 0").select("slot", "chunk", "level", "n_often", "ranks")
        told, _ = _stored(by_slot(ranks.unionByName(weights.mapInArrow(_give_weights, GIVEN), allowMissingColumns=True)).mapInArrow(_answer_weights, WEIGHTS), "weights")
    _discard(spark, path, *kept)
    known = answers.select("chunk", "level", "slot", "n", "often", F.when(F.col("level") == 1, F.col("totals")).alias("totals"))
    found = _met(chunks, answers=known, weights=told).mapInArrow(_score(plan, kind, total, vocabulary), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
