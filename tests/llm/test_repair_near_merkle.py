"""Conversation repair, MinHash components and Merkle proofs against brute force."""

import collections
import functools
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relievo.llm import conversation_repair, merkle, near_dedup, ngram_join, queries

BLACK = re.compile("[^\x20\x09-\x0d]")
AWKWARD = [
    (1, 1, "system", "You help."), (1, 2, "user", "What?"), (1, 3, "assistant", "This"), (1, 5, "user", " \n"), (1, 6, "assistant", "So."), (1, 6, "assistant", "So."),
    (2, 1, "assistant", "Hello."), (2, 2, "user", "Hi!"), (3, None, "tool", "x."), (3, None, None, None), (3, 2, "", "empty role."), (None, 1, "user", "no id."), (None, None, "user", None),
    (4, 1, "user", "a."), (4, 1, "user", "a."), (4, 1, "user", "b"), (4, 1, "assistant", "c é."), (5, 3, "systems", "x" * 100_000), (6, 1, "user", ""), (7, 1, "assistant", "."),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        role, text, kind = one(role), one(text), zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def audited(turns):
    """The least (cost, edits, lines) by trying all edits of every turn in every state."""
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in turns:
        last = BLACK.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    legal = re.compile("(s?(ua)+)?")

    @functools.cache
    def best(i, done, inserts):
        found = [(0, "", ())] if i == len(turns) and legal.fullmatch(done) else []

        def go(cost, letter, role, text, *to):
            if role is None or re.fullmatch("s?(ua)*u?", done + role[:1]) and role:
                more = best(to[0], done + (role or "")[:1], to[1])
                if more:
                    found.append((cost + more[0], letter + more[1], (() if role is None else (f"{role}:{text}",)) + more[2]))

        if i < len(turns):
            _, _, role, text = turns[i]
            more = 5 * (faults[i] == "truncated")
            go(2, "D", None, "", i + 1, 0)
            if faults[i] not in ("blank", "duplicate"):
                if role:
                    go(more, "K", role, text, i + 1, 0)
                for other in ("user", "assistant"):
                    go(1 + more, "R", other, text, i + 1, 0)
        if inserts < 3:
            for other in ("user", "assistant"):
                go(5, "I", other, "", i, inserts + 1)
        return min(found) if found else None

    cost, audit, lines = best(0, "", 0)
    numbers = [t for _, t, _, _ in turns if t is not None]
    initials = [r[:1] for _, _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))


def test_repairs_are_the_cheapest(spark):
    rng = np.random.default_rng(11)
    texts, roles = ["a.", "b!", "c", "", " ", "d?", "e. "], ["user", "assistant", "system", "tool", "user", "assistant"]
    rows = AWKWARD + [(int(c) + 100, int(rng.integers(0, 9)), str(rng.choice(roles)), str(rng.choice(texts))) for c in range(120) for _ in range(rng.integers(1, 9))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"edit": F.lit("x"), "rid": F.lit(1), "place": F.lit(2)}).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.audits(table, conversation_repair.damaged(table)).collect()}
    left = collections.defaultdict(list)
    for r in damaged_rows(rows):
        left[r[0]].append(r)
    want = {c: audited(left[c]) if c in left else (0,) * 6 + ("", sha("")) for c in {r[0] for r in rows}}
    assert got == want and len({w[6] for w in want.values()}) > 40
    assert conversation_repair.audits(table.limit(0), conversation_repair.damaged(table.limit(0))).count() == 0


def test_a_conversation_may_lie_in_many_tasks(spark):
    """All rows but a few are one conversation, sorted into every task; many repeat one line."""
    rng = np.random.default_rng(5)
    rows = [(7, int(k // 3), str(rng.choice(["user", "assistant", "system"])), "again." if k % 2 else f"line {k}{rng.choice(['.', ''])}") for k in range(1200)] + [(6, 1, "user", "x."), (8, 1, "user", "y.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = conversation_repair.repaired(table).cache()
        assert found.where("conv_id = 7").select(F.shiftright("place", 33).alias("p")).distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.conv_id: r for r in conversation_repair.audits(table, table).collect()}
    turns = [(c, t, r, x) for c, t, r, x in rows if c == 7]
    turns.sort(key=lambda r: (r[1], r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, plain = set(), []
    for _, _, role, text in turns:
        plain.append((conversation_repair.DUPLICATE_ if (role, text) in seen else 0 if text.endswith(".") else conversation_repair.TRUNCATED_, role[0]))
        seen.add((role, text))
    edits, state = conversation_repair.walk(plain, 0, conversation_repair.AT_END, True)
    assert state in (0, 3) and got[7].audit == "".join(e[1] for e in edits) and got[7].cost == sum(e[3] for e in edits)
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in sorted(found.where("conv_id = 7 AND edit <> 'D'").collect(), key=lambda r: r.place)))
    assert "".join(r.edit for r in sorted(found.where("conv_id = 7").collect(), key=lambda r: r.place)) == got[7].audit
    assert found.where("conv_id = 7 AND illegal").count() == got[7].illegal
    initials = [p[1] for p in plain]
    assert got[7].illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def shingle_set(text, n=5):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def components_by_hand(rows, num):
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    return collections.Counter((rows[k][0], len(sets[k]), rows[min((j for j in range(len(rows)) if find(j) == find(k)), key=order)][0]) for k in range(len(rows)))


@pytest.fixture(scope="module")
def copies():
    """Chains of near copies of many lengths and distances, exact copies, short and blank texts."""
    rng = np.random.default_rng(2)
    rows = [(None, None), (900, ""), (901, " \n"), (902, "one two"), (903, "ONE  two"), (904, "one two three"), (None, "one two"), (905, " ".join(f"l{k}" for k in range(30_000))), (906, " ".join(f"l{k}" for k in range(29_500)))]
    for group in range(25):
        words = [f"g{group}w{k}" for k in range(int(rng.integers(6, 150)))]
        for copy in range(int(rng.integers(1, 9))):
            rows.append((group * 10 + copy, " ".join(words)))
            at = int(rng.integers(0, len(words)))
            words[at : at + int(rng.integers(0, 3))] = [f"n{group}x{copy}"] * int(rng.integers(0, 3))
    rows += [(500 + k, rows[20][1].upper()) for k in range(30)]
    return [rows[k] for k in rng.permutation(len(rows))]


def test_minhash_components(spark, copies):
    table = spark.createDataFrame(copies, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("mark", "n", "rid", "key", "rec")}).repartition(3)
    found = near_dedup.near_components(table).cache()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == components_by_hand(copies, 85)
    assert len({r.component_id for r in found.collect()}) > 40 and near_dedup.near_components(table.limit(0)).count() == 0
    one = {(r.doc_id, r.mark) for r in found.where("first AND n_shingles > 0").collect()}
    assert len(one) == len({r.component_id for r in found.where("n_shingles > 0").collect()})


def test_half_keys_match_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    hits = []
    for _ in range(150):
        other = np.concatenate([base[:368], rng.integers(0, 1 << 64, 32, dtype=np.uint64)])  # 368 of 432
        hits.append(near_dedup.half_keys(base) == near_dedup.half_keys(other))
        base = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    assert abs(np.mean(hits) - (368 / 432) ** 2) < 0.03


def test_near_misses_are_not_expanded(spark):
    """Thousands of pages of one template, each too far from all others: few pairs are held against whole sets."""
    template = [f"t{k}" for k in range(110)]
    pages = [(k, " ".join([*template, *(f"p{k}w{j}" for j in range(16))])) for k in range(400)]  # 106 of 138 shingles: 0.77
    verified = []
    real = ngram_join._verified

    def counting(pairs, *rest):
        verified.append(pairs.count())
        return real(pairs, *rest)

    ngram_join._verified = counting
    try:
        found = near_dedup.near_components(spark.createDataFrame(pages, "doc_id long, text string").repartition(4))
        assert found.where("component_id <> doc_id").count() == 0
    finally:
        ngram_join._verified = real
    assert sum(verified) < 60 * len(pages)


def by_hand(rows):
    """The whole manifest level by level: leaf, subroot, root, proof, of rows (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
            for path, k in zip(paths, at, strict=True):
                path += [(k % 3, [x for j, x in enumerate(runs[k // 3]) if j != k % 3])]
            nodes, at = [sha("".join(r)) for r in runs], [k // 3 for k in at]
        return nodes[0], paths

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    for s, top in zip(sources, tops, strict=True):
        for r, path in zip(own[s], trees[s][1], strict=True):
            whole, text = path + top, r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            fold = leaf((*r[:4], text))
            for place, others in whole:
                fold = sha("".join([*others[:place], fold, *others[place:]]))
            yield r[0], leaf(r), trees[s][0], root, sha("".join(x for _, others in whole for x in others)), fold, fold == root


def test_manifest(spark, tmp_path):
    rng = np.random.default_rng(3)
    text = lambda: str(rng.choice(["", "a\nb", "no newline", "é\n漢", "\n"]))
    rows = [(k, s, "en", int(k) % 7, text() + str(k)) for s, n in ((None, 5), ("a", 1), ("b", 9), ("é", 250), ("z", 10), ("", 27), ("big", 800)) for k in rng.permutation(n).tolist()]
    rows += [(None, "b", None, None, None), (3, "b", None, None, None), (3, "b", None, None, None), (None, None, "", None, "\n"), (5, "long", "x", -1, "y\n" * 60_000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("x") for c in ("g", "idx", "n", "part", "path", "digest")}).repartition(5)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect())
    assert got == collections.Counter(by_hand(rows)) and 0 < sum(n for r, n in got.items() if not r[-1]) < len(rows)
    tiers = merkle.manifest(table, merkle.without_newlines(), block=2)  # five tiers for the largest source
    assert collections.Counter((r.doc_id, bytes(r.subroot).hex(), r.proof_sha256, bytes(r.folded_root).hex()) for r in tiers.collect()) == collections.Counter((r[0], r[2], r[4], r[5]) for r in by_hand(rows))
    assert merkle.manifest(table).where("verified").count() == len(rows) and merkle.manifest(table.limit(0)).count() == 0


def test_traversal_holds_a_few_subtrees():
    """Paths equal those of the whole tree at any ragged size, and what is held stays within two subtrees a band."""
    for n in (1, 2, 3, 4, 26, 27, 28, 81, 200, 243):
        leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        for top in {merkle.height_of(n), 5}:
            root = merkle.root_of(leaves, top)
            assert all(merkle.folded(leaf, merkle.packed(path))[0] == root for leaf, path in zip(leaves, merkle.traversal(leaves, top), strict=True))
            assert all(0 <= place <= len(others) <= 2 for path in merkle.traversal(leaves, top) for place, others in path)
    held = merkle.Subtree(2, 4)
    for k in range(81):
        held.add(bytes([k]))
    assert sum(map(len, held.nodes)) == 9 + 3 and held.root == merkle.root_of([bytes([k]) for k in range(81)], 4)
