"""Jaccard self-join on word shingles by rare-first prefix filtering.

1.  Half of the hash space of the shingles is counted over all documents, in sorted blobs
    that are dealt by hash range.  Of a document with a partner, all but the few shingles
    that a partner may lack must be shared in that half too; documents that fall short of
    this exact bound cannot link and are done.
2.  The others are put into classes of equal sets; one document stands for each.  Its
    shingles are ordered rare first, by how many sets hold them.
3.  Sets that link share a shingle of their prefixes.  A list of the sets that have a
    shingle in their prefix is not expanded into pairs: first two of its members
    meet all others that are not in their component yet.  Then only pairs of different
    components are left to be met, of which at least one lies outside the list's largest
    component.  So a list of thousands of near copies costs a few times its length in pairs.
4.  Pairs pass the length, positional and suffix filters (sizes of the sets' parts under
    fixed pivots bound the overlap), are made distinct, and are verified once by
    intersecting whole sets.

Rows that pass between executors are hashes and counts; texts are read twice where they lie.

Defined cases: null or blank texts have no shingles and link with nothing; texts with fewer
words than a shingle are one shingle of all their words; equal texts are one class; repeated
rows each get a row; a null doc_id counts as larger than all others; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relievo.llm.common import cut, grouped, small, text_of, with_row
from relievo.operators.graphs import components

PARTS = 16
#: Bits of a set's parities, and rows of a list's block when pairs that are left meet.
PARITY_BITS, LIST_BLOCK = 1024, 2000
PACK_HASHES, PACK_DOCS = 600_000, 60_000
#: Bytes of text whose counted hashes meet in a slot, on average and at most; they take some four times as much in a task.
SLOT_BYTES = 32 << 20
_K, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles."""
    words = text.encode().lower().split()  # bytes lower A-Z only and split at the six blanks
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            h = h * _K + w[k : len(w) - size + 1 + k]
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
    return np.unique(h ^ (h >> np.uint64(31)))


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sketch(n: int, slots: int, schema: pa.Schema):
    """Per pack of documents: a row per document, and a blob of counted hashes per slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack = TaskContext.get().partitionId() << 33
        sets: list[np.ndarray] = []
        rows: list[tuple] = []
        held = 0

        def table(columns: dict) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                ids, marks, sizes, counted, recs = zip(*rows, strict=True)
                place = range(len(rows))
                yield table({"slot": [(pack + k) % slots for k in place], "pack": [pack] * len(rows), "place": list(place), "doc_id": list(ids), "mark": list(marks), "n": list(sizes), "counted": list(counted), "rec": list(recs)})
                h = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
                slot = (h % np.uint64(slots)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                ends = np.cumsum(np.bincount(slot, minlength=slots))
                low = np.ascontiguousarray((h[order] >> np.uint64(20)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                doc = doc[order].astype("<u2")
                starts = np.concatenate([[0], ends[:-1]])
                full = np.flatnonzero(ends > starts)
                spans = list(zip(starts[full].tolist(), ends[full].tolist(), strict=True))
                for at in range(0, len(full), 512):
                    some = spans[at : at + 512]
                    yield table({"slot": full[at : at + 512].tolist(), "pack": [pack] * len(some), "hashes": [low[a:b].tobytes() for a, b in some], "places": [doc[a:b].tobytes() for a, b in some]})

        for batch in batches:
            for doc_id, mark, text in zip(*(batch.column(c) for c in ("doc_id", "mark", "text")), strict=True):
                h = shingles(text.as_py(), n)
                half = h[: np.searchsorted(h, np.uint64(1 << 63))]
                rows.append((doc_id.as_py(), mark.as_py(), len(h), len(half), digest(h)))
                sets.append(half)
                held += len(half)
                if held >= PACK_HASHES or len(rows) >= PACK_DOCS:
                    yield from flush()
                    pack, sets, rows, held = pack + 1, [], [], 0
        yield from flush()
        pa.default_memory_pool().release_unused()  # the worker lives on for other stages

    return run


def _count_shared(schema: pa.Schema):
    """Per slot: for each pack, how many hashes of which document another document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "slot"):
            is_blob = pc.is_valid(table["hashes"])
            docs = table.filter(pc.invert(is_blob))
            if len(docs):
                yield from docs.select(["pack", "place", "doc_id", "mark", "n", "counted", "rec"]).append_column("places", pa.nulls(len(docs), pa.binary())).append_column("shared", pa.nulls(len(docs), pa.binary())).cast(schema).to_batches()
            blobs = table.filter(is_blob)
            if not len(blobs):
                continue
            raw = np.frombuffer(b"".join(blobs["hashes"].to_pylist()), dtype=np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), dtype=np.uint8)
            wide[:, :5] = raw
            _, inverse, counts = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
            shared = counts[inverse] > 1
            packs, places, sums, at = blobs["pack"].to_pylist(), [], [], 0
            for blob in blobs["places"].to_pylist():
                place = np.frombuffer(blob, dtype="<u2")
                which, many = np.unique(place[shared[at : at + len(place)]], return_counts=True)
                places.append(which.tobytes())
                sums.append(many.astype("<u4").tobytes())
                at += len(place)
            columns = {"pack": packs, "places": places, "shared": sums}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(packs), f.type) for f in schema], schema=schema)

    return run


def _survivors(num: int, den: int, schema: pa.Schema):
    """Per pack: which documents share enough of their counted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "pack"):
            is_doc = pc.is_valid(table["place"])
            total = np.zeros(PACK_DOCS, dtype=np.int64)
            for places, shared in zip(*(table.filter(pc.invert(is_doc))[c].to_pylist() for c in ("places", "shared")), strict=True):
                total[np.frombuffer(places, dtype="<u2")] += np.frombuffer(shared, dtype="<u4")
            docs = table.filter(is_doc)
            n, counted = docs["n"].to_numpy(), docs["counted"].to_numpy()
            missing = n + (-num * n) // den
            alive = (n > 0) & (total[docs["place"].to_numpy()] >= counted - missing)
            yield from docs.select(["doc_id", "mark", "n", "rec"]).append_column("alive", pa.array(alive)).cast(schema).to_batches()

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def slots_for(docs: DataFrame, partitions: int, slot_bytes: int = SLOT_BYTES) -> int:
    """Slots for all hashes: from the counted bytes of the texts, so that a slot's size does not grow with the corpus."""
    size = docs.agg(F.sum(F.octet_length(text_of()).cast("long"))).first()[0] or 0
    return max(8 * partitions, -(-size // slot_bytes))


def sketched(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, mark (of the text), n, rec (digest of the set), alive (may have a partner): one row per row of ``docs``."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    doc_id = rows.schema["doc_id"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = slots_for(docs, partitions)
    partitions = max(partitions, slots // 8)
    field = lambda name, kind: T.StructField(name, kind)
    about = [doc_id, field("mark", T.LongType()), field("n", T.LongType()), field("counted", T.LongType()), field("rec", T.BinaryType())]
    first = T.StructType([field("slot", T.LongType()), field("pack", T.LongType()), field("place", T.LongType()), *about, field("hashes", T.BinaryType()), field("places", T.BinaryType())])
    second = T.StructType([field("pack", T.LongType()), field("place", T.LongType()), *about, field("places", T.BinaryType()), field("shared", T.BinaryType())])
    third = T.StructType([doc_id, field("mark", T.LongType()), field("n", T.LongType()), field("rec", T.BinaryType()), field("alive", T.BooleanType())])
    dealt = rows.mapInArrow(_sketch(n, slots, _arrow(first)), first).repartition(partitions, "slot").sortWithinPartitions("slot")
    back = dealt.mapInArrow(_count_shared(_arrow(second)), second).repartition(partitions, "pack").sortWithinPartitions("pack")
    return back.mapInArrow(_survivors(num, den, _arrow(third)), third)


def set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, hashes, parts, bits = [], [], [], []
            for rid, rec, text in zip(*(batch.column(c) for c in ("rid", "rec", "text")), strict=True):
                h = shingles(text.as_py(), n)
                if digest(h) == rec.as_py():  # a mark may stand for several texts
                    rids.append(rid.as_py())
                    hashes.append(h.view(np.int64))
                    parts.append(np.bincount((h >> np.uint64(60)).astype(np.int64), minlength=PARTS))
                    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
                    bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (hashes, parts, bits))], ["rid", "hashes", "parts", "bits"])

    return run


SET = "rid long, hashes array<long>, parts array<long>, bits array<long>"


def _overlap(n: Column, m: Column, num: int, den: int) -> Column:
    """The least intersection of linked sets of these sizes."""
    return F.ceil(F.lit(num) * (n + m) / F.lit(num + den))


def _filtered(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Length and positional filters, then distinct pairs.  From the first shingle that both prefixes have, the rest bounds the overlap."""
    n, m = F.col("n_a"), F.col("n_b")
    length = F.lit(den) * F.least(n, m) >= F.lit(num) * F.greatest(n, m)
    position = 1 + F.least(n - F.col("pos_a") - 1, m - F.col("pos_b") - 1) >= _overlap(n, m, num, den)
    return pairs.where(length & position).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that link: suffix filter, then the intersection of whole sets."""
    side = lambda s: sets.select(F.col("rid").alias(s), F.col("n").alias(f"n_{s}"), F.col("parts").alias(f"parts_{s}"), F.col("shared").alias(f"shared_{s}"))
    n, m = F.col("n_a"), F.col("n_b")
    apart = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= n + m - 2 * _overlap(n, m, num, den))
    both = F.size(F.array_intersect("shared_a", "shared_b"))
    return cut(met.select("a", "b", n.alias("n_a"), m.alias("n_b"), both.alias("both")).where(F.lit(den) * F.col("both") >= F.lit(num) * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"))


PAIR = "a long, n_a long, pos_a long, b long, n_b long, pos_b long"


def _near_pairs(num: int, den: int, one: bool):
    """Of a block of members against another: pairs whose sizes and parities allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "slot"):
            outer = table["outer"].to_numpy()
            rid, n, pos, c, main = (table[x].to_numpy() for x in ("rid", "n", "pos", "c", "main"))
            bits = table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rid), -1)
            left, right = np.flatnonzero(outer), np.flatnonzero(~outer)
            for some in (left[k : k + 64] for k in range(0, len(left), 64)):
                x, y = some[:, None], right[None, :]
                both = n[x] + n[y]
                odd = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=2, dtype=np.int64)
                near = (c[x] != c[y]) & ((c[y] == main[x]) | (rid[x] < rid[y])) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])) & (odd <= both + 2 * (-num * both // (num + den)))
                i, j = np.nonzero(near)
                i, j = some[i], right[j]
                if one and len(i):
                    _, first = np.unique(np.stack([rid[i], c[j]]), axis=1, return_index=True)
                    i, j = i[first], j[first]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (rid[i], n[i], pos[i], rid[j], n[j], pos[j])], ["a", "n_a", "pos_a", "b", "n_b", "pos_b"])

    return run


def _left(here: DataFrame, about: DataFrame, num: int, den: int, one: bool) -> DataFrame:
    """Pairs of different components of a list whose sets can be near, one of them outside the list's largest component.

    A list is dealt by blocks of members, and each block meets each, so that no task holds more
    than two blocks of a list, and rows are made only for pairs that the sets' parities leave:
    sets differ in at least as many shingles as their parities differ in bits.  With ``one`` a
    member gets one pair a block and component, as most of these link and make the others
    needless.
    """
    of_list = here.groupBy("token", "c").agg(F.count("*").alias("many")).groupBy("token").agg(F.max(F.struct("many", "c")).alias("main"), F.sum("many").alias("size"), F.count("*").alias("kinds"))
    blocks = F.ceil(F.col("size") / LIST_BLOCK).cast("int").alias("blocks")
    here = here.join(of_list.where("kinds > 1").select("token", F.col("main.c").alias("main"), blocks), "token")
    here = here.join(about.select(F.col("rid").alias("b_rid"), "bits"), F.col("rid") == F.col("b_rid"))
    own, every = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    outer = F.when(F.col("c") != F.col("main"), F.transform(every, lambda k: F.struct(F.lit(True).alias("outer"), F.xxhash64("token", own, k).alias("slot"))))
    inner = F.transform(every, lambda k: F.struct(F.lit(False).alias("outer"), F.xxhash64("token", k, own).alias("slot")))
    dealt = here.withColumn("role", F.explode(F.concat(F.coalesce(outer, F.array().cast("array<struct<outer:boolean,slot:bigint>>")), inner)))
    dealt = dealt.select("role.*", "rid", "n", F.col("pos").cast("long").alias("pos"), "c", "main", "bits").repartition("slot").sortWithinPartitions("slot")
    return dealt.mapInArrow(_near_pairs(num, den, one), PAIR)


def linked(postings: DataFrame, about: DataFrame, num: int, den: int, rounds: int = 1) -> DataFrame:
    """node, component for the sets that link to others.

    In a round two members of each list meet all that are in other components: the one with
    the least ``apart``, the likeliest to be near all others, and one drawn by a hash (in later
    rounds both).  Lists that are inside one component are done.  After the rounds members of different components that can be near meet, first one pair for each two
    components, then all that are still apart, so no link is lost.
    """
    postings, links, tested, joined = cut(postings), None, None, None

    def meet(pairs: DataFrame) -> None:
        nonlocal links, tested, joined
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        found = _verified(pairs, about, num, den)
        links, tested = (found, pairs) if links is None else (links.union(found), tested.union(pairs))
        joined = components(links)

    def placed() -> DataFrame:
        if joined is None:
            return postings.withColumn("c", F.col("rid"))
        return postings.drop("c").join(joined, F.col("rid") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rid")).drop("node", "component")

    for k in range(rounds):
        here = placed() if k == 0 else cut(placed())
        drawn = F.xxhash64(F.lit(k), "rid")
        first = F.struct((F.col("apart") if k == 0 else drawn).alias("key"), "rid", "n", "pos", "c")
        last = F.struct(drawn.alias("key"), "rid", "n", "pos", "c")
        lists = here.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(first).alias("lo"), F.max(last).alias("hi")).where("c0 <> c1")
        leaders = cut(lists.select("token", *[F.struct(*[f"{s}.{f}" for f in ("rid", "n", "pos", "c")]).alias(s) for s in ("lo", "hi")]))
        met = here.join(leaders, "token")
        postings = cut(met.select(*here.columns))
        ends = met.select(F.col("rid").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), "c", F.explode(F.array("lo", "hi")).alias("end")).where("end.c <> c")
        meet(_filtered(ends.select(F.col("end.rid").alias("a"), F.col("end.n").alias("n_a"), F.col("end.pos").alias("pos_a"), "b", "n_b", "pos_b"), num, den))
    meet(_filtered(_left(cut(placed()), about, num, den, True), num, den))
    meet(_filtered(_left(cut(placed()), about, num, den, False), num, den))
    return joined


def place_of() -> Column:
    """The order of documents: by doc_id, nulls last, then mark."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")


def sets_of(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """rid, hashes, parts, bits of each class (rid, rec, label), from the text of the document that stands for it."""
    stands = classes.select("rid", "rec", F.col("label.doc_id").alias("l_id"), F.col("label.mark").alias("l_mark"))
    texts = docs.select("doc_id", text_of().alias("text")).join(small(stands, 72), F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.xxhash64("text") == F.col("l_mark"))).select("rid", "rec", "text")
    return cut(texts.mapInArrow(set_rows(words), SET))


def labelled(info: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, first, from the rows (doc_id, mark, n, rec), their classes and the components of these."""
    named = classes.join(joined, F.col("rid") == F.col("node"), "left").select("rec", "label", F.coalesce("component", "rid").alias("c"))
    least = named.groupBy("c").agg(F.min("label").alias("least"))
    of_rec = cut(named.join(least, "c").select(F.col("rec").alias("r"), "least"))
    found = info.join(small(of_rec, 72), F.col("rec") == F.col("r"), "left")
    inside = F.col("least").isNotNull()
    return found.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.when(inside, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), (~inside | F.col("least").eqNullSafe(place_of())).alias("first"))


def similar_components(docs: DataFrame, words: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, first: one row per row of ``docs``.

    Sets link when den * |intersection| >= num * |union|.  ``first`` is true for the document
    with the smallest doc_id (then mark) of a component, and for its repeated rows.
    """
    info = cut(sketched(docs, words, num, den))
    classes = info.where("alive").groupBy("rec").agg(F.min(place_of()).alias("label"), F.first("n").alias("n"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("rid"), "rec", "label", "n"))
    sets = sets_of(docs, classes, words)
    tokens = sets.select("rid", F.explode("hashes").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(df, "token").groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("ranked"))
    rare = F.col("n") - F.size("ranked")
    prefix = (F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den)) + 1 - F.col("rare")).cast("int")
    about = classes.join(ranked, "rid").withColumn("rare", rare).withColumn("prefix", prefix).where("prefix > 0")
    about = about.join(sets.select("rid", "parts", "bits"), "rid").dropDuplicates(["rid"])
    about = cut(about.select("rid", "n", "rare", "prefix", "parts", "bits", F.transform("ranked", lambda x: x["token"]).alias("shared")))
    postings = about.select("rid", "n", "rare", F.posexplode(F.slice("shared", 1, F.col("prefix"))).alias("at", "token"))
    postings = postings.select("token", "rid", "n", (F.col("rare") / F.col("n")).alias("apart"), (F.col("rare") + F.col("at")).alias("pos"))
    joined = linked(postings, about, num, den)
    return labelled(info, classes, joined)


def without_near_copies(docs: DataFrame, words: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The documents with one of each component left, columns unchanged, whatever their names."""
    found = cut(similar_components(docs, words, num, den))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text_of("row.text")) == F.col("mark"))
    gone = found.where(~F.col("first")).select("doc_id", "mark").distinct()
    stay = with_row(docs).join(small(cut(gone), 24), same, "left_anti")
    # Rows that repeat a doc_id and text have one component; only where there are such rows are they grouped.
    again = cut(found.where("first AND n_shingles > 0").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if again.isEmpty():
        return stay.select("row.*")
    one = stay.join(small(again, 32), same).dropDuplicates(["doc_id", "mark"]).select("row")
    return stay.join(small(again, 32), same, "left_anti").unionByName(one).select("row.*")
