"""Hard negatives, the conversation trie and online packing against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weblode.llm import exact_dedup, hard_negatives, ngram_join, packing, prefix_trie
from weblode.llm.common import words_of

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

# --- 11: hard negatives ---


def ranked(rows, q, label, same, anchor):
    found = {}
    for i, own, x in rows:
        if (own == label and i != anchor) if same else own != label:
            score = int(x @ q)
            found[i] = max(score, found.get(i, score))
    return sorted(((s, i) for i, s in found.items()), key=lambda p: (-p[0], p[1]))


def brute_negatives(rows, anchors):
    out = set()
    for i, label, q in anchors:
        for ps, p in ranked(rows, q, label, True, i)[:5]:
            fits = [(s, n) for s, n in ranked(rows, q, label, False, i) if 50 * ps <= 100 * s <= 95 * ps][:3]
            out |= {(i, p, k + 1, n, ps, s) for k, (s, n) in enumerate(fits)}
    return out


VECTORS = "vec_id long, embedding array<float>, label int, score long, cell string, vector string, rank int"


def vector_frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, x, label, 1, "c", "v", 2) for i, x, label in rows], VECTORS).repartition(parts)


def usable(rows):
    kept = [(i, label, np.floor(256 * np.array(x, np.float32).astype(float))) for i, x, label in rows if None not in (i, x, label) and None not in x]
    return [(i, label, v.astype(np.int64)) for i, label, v in kept if np.isfinite(v).all()]


@pytest.mark.parametrize("block,chunk", [(16, 2), (1024, 512)])
def test_hard_negatives_equal_brute_force(spark, block, chunk):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(4, 8))
    rows = [(i, (middle[i % 4] + 0.3 * rng.normal(size=8)).tolist(), i % 3) for i in range(120)]
    rows += [(200 + i, middle[0].tolist(), i % 2) for i in range(60)]  # a hot vector, and ties
    rows += [(1000, None, 1), (1001, [1.0] * 8, None), (1002, [None] + [1.0] * 7, 1), (1003, [float("nan")] * 8, 0), (1050, [float("inf")] * 8, 0), (None, [1.0] * 8, 1)]
    rows += [(50, rows[50][1], rows[50][2]), (77, rows[3][1], 2)]  # a repeated row and a repeated identifier
    rows += [(1100, [0.0] * 8, 1), (1200, [-1.0] * 8, 9)]
    frame = vector_frame(spark, rows)
    whole = hard_negatives.vectors(frame)
    got = {tuple(r) for r in hard_negatives.mine(whole, whole.filter("vec_id % 50 = 0"), block=block, chunk=chunk).collect()}
    want = usable(rows)
    anchors = {i: (i, label, x) for i, label, x in want if i % 50 == 0}
    assert got == brute_negatives(want, anchors.values()) and got


def test_hard_negatives_store_no_row_for_each_anchor_and_block(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, (x / np.linalg.norm(x)).tolist(), i % 4) for i, x in enumerate(rng.normal(size=(400, 24)))]
    sizes = {}

    def counted(df, name, stored=hard_negatives.stored):
        out = stored(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(hard_negatives, "stored", counted)
    whole = hard_negatives.vectors(vector_frame(spark, rows))
    got = {tuple(r) for r in hard_negatives.mine(whole, whole.filter("vec_id % 2 = 0"), block=8).collect()}
    want = usable(rows)
    assert got == brute_negatives(want, want[::2]) and got
    assert sizes["negatives-trees"] >= 50
    assert max(sizes.values()) <= 200 * 5 * 3  # what is found, but not anchors times blocks


@pytest.mark.parametrize("most", [1, 1 << 8, 1 << 18])  # scores are computed in three types of number
def test_hard_negatives_in_several_turns(spark, most):
    rng = np.random.default_rng(most)
    middle = rng.normal(size=(3, 6))
    rows = [(i, (most * (middle[i % 3] + 0.2 * rng.normal(size=6)))[: 4 + i % 3].tolist(), i % 5) for i in range(150)]
    whole = hard_negatives.vectors(vector_frame(spark, rows))
    got = {tuple(r) for r in hard_negatives.mine(whole, whole.filter("vec_id % 3 = 0"), block=32, chunk=4, sent=1200).collect()}
    want = [(i, label, np.pad(x, (0, 6 - len(x)))) for i, label, x in usable(rows)]
    assert got == brute_negatives(want, [r for r in want if r[0] % 3 == 0]) and got


def test_cover_tree_takes_anchors_together():
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(6, 12)) * 300
    x = np.floor(middle[rng.integers(0, 6, 700)] + rng.normal(size=(700, 12)) * rng.choice([1, 30], (700, 1))).astype(np.int64)
    tree = hard_negatives.build_tree(x, most := float((x.astype(float) ** 2).sum(1).max()))
    point, labels, ids = tree[0], rng.integers(0, 3, 700), np.arange(700) // 2  # identifiers come twice
    low, high = np.tile([-(1 << 62), 1000], (50, 1)), np.tile([1 << 62, 200000], (50, 1))
    best = hard_negatives._Best(4, low, high)
    other = lambda nodes, anchors: labels[point[nodes]] != labels[anchors]
    hard_negatives.search_tree(tree, x[point], ids[point], np.ones(len(point), bool), x[:50], most, best, counts=other)
    for a in range(50):
        score = x @ x[a]
        for own, (lowest, highest) in zip(best.found[2 * a : 2 * a + 2], ((-(1 << 62), 1 << 62), (1000, 200000)), strict=True):
            once = {}
            for i in np.flatnonzero((labels != labels[a]) & (score >= lowest) & (score <= highest)).tolist():
                once[int(ids[i])] = min(-int(score[i]), once.get(int(ids[i]), 1 << 62))
            assert own == sorted((s, i) for i, s in once.items())[:4]


def test_hard_negatives_without_rows(spark):
    none = hard_negatives.vectors(vector_frame(spark, []))
    assert hard_negatives.mine(none, none).count() == 0
    one = hard_negatives.vectors(vector_frame(spark, [(0, [1.0], 1)]))
    assert hard_negatives.mine(one, one).count() == 0


def test_cover_tree_covers_and_skips():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16)) * 400
    x = np.floor(middle[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * 10).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(1).max())
    tree = point, first, end, radius, again = hard_negatives.build_tree(x, most)
    assert sorted(point[~again].tolist()) == list(range(900))
    lifted = hard_negatives._lifted(x, most)

    def under(at):
        for c in range(first[at], end[at]):
            yield c
            yield from under(c)

    for at in range(0, len(point), 7):
        assert all(np.linalg.norm(lifted[point[c]] - lifted[point[at]]) <= radius[at] + 1e-6 for c in under(at))
    ids, everything = point, np.ones(len(point), bool)
    seen = 0
    for q in x[:40]:
        best = hard_negatives._Best(5, np.array([-(1 << 62)]), np.array([1 << 62]))
        seen += hard_negatives.search_tree(tree, x[point], ids, everything, q, most, best, True)
        score = x @ q
        want = sorted(((-int(s), int(i)) for i, s in enumerate(score)))[:5]
        assert best.found[0] == want
        low, high = hard_negatives.bounds(score[:1].astype(float), float(q @ q), most, np.array([np.linalg.norm(lifted - lifted[0], axis=1).max()]))
        assert low[0] <= score.min() and score.max() <= high[0]
    assert seen < 40 * 900 / 2  # most scores are never computed
    windowed = hard_negatives._Best(3, np.array([100, -50]), np.array([100000, 50]))
    hard_negatives.search_tree(tree, x[point], ids, everything, x[7], most, windowed, True)
    score = x @ x[7]
    for own, (a, b) in zip(windowed.found, ((100, 100000), (-50, 50)), strict=True):
        assert own == sorted((-int(s), int(i)) for i, s in enumerate(score) if a <= s <= b)[:3]


# --- 12: conversation trie ---


def brute_trie(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    if not convs:
        return set()
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = set()

    def total(node):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves = 0 if children[node] else 1
        for c in children[node]:
            s, n = total(c)
            saved, leaves = saved + s, leaves + n
        ends = sorted(c for c in members[node] if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return saved, leaves

    total(())
    return out


def turn_digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def originals(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, turn_digest(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(own, key=lambda x: x[:3])] for c, own in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def conversation_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 7) for r in rows], "conv_id long, turn long, role string, text string, depth int, a string, bytes long").repartition(3)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def made_conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, 40):
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "é", "yes", "no"]) if t > 1 else "hello"))
    rows += [(100, None, "user", "x"), (100, 0, "us", "erx"), (100, 0, "us", "erx"), (None, 0, "user", "lost")]
    rows += [(c, t, "user", f"turn {t}") for c in (200, 205, 210) for t in range(30)]  # a hot group of copies
    return rows


@pytest.mark.parametrize("rebuild,height,block", [(True, 8, 256), (True, 2, 3), (False, 2, 2), (False, 3, 256)])
def test_trie_equals_brute_force(spark, rebuild, height, block):
    rows = made_conversations()
    got = prefix_trie.conversation_trie(conversation_frame(spark, rows), rebuild=rebuild, height=height, block=block).select(*COLUMNS).collect()
    convs = originals(rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_trie(rebuilt(convs) if rebuild else convs)))


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(4, t, "user", f"t{t}") for t in range(700)] + [(9, t, "user", f"t{t}") for t in range(500)]
    got = prefix_trie.conversation_trie(conversation_frame(spark, rows), height=4, block=16).select(*COLUMNS).collect()
    want = {r[1]: r for r in brute_chain(rows)}
    assert {r.depth: tuple(r) for r in got} == want
    assert prefix_trie.conversation_trie(conversation_frame(spark, []), rebuild=True).count() == 0


def brute_chain(rows):
    """Two conversations of which one is the other's beginning."""
    text = [f"t{t}" for t in range(700)]
    saved = np.cumsum([0, *(len(t) for t in text[:500])])
    none = hashlib.sha256(b"").hexdigest()
    for d in range(701):
        ends = {500: "9", 700: "4"}.get(d)
        below = saved[-1] - saved[max(d - 1, 0)] if d <= 500 else 0
        yield (4, d, 4 if d else None, 2 if d <= 500 else 1, int(d < 700), 1, int(below), hashlib.sha256(ends.encode()).hexdigest() if ends else none)


# --- 13: packing ---

TEXTS = [
    None, "", " \t\n", "Hello, WORLD's don't we'll 'station ''s", "é É İ ß Ǆ ª ² ½ · «» x\x85y z\xa0w \x1c\x1d\x1e", "日本語 テキスト ΑΣ ΣΑΣ's é ́ x",
    "<|startoftext|> hi<|endoftext|>x", "a" * 70 + " " + "Ab9" * 40, "x" * 5000, "1234 12,5 ..!?(' \r\r\n", "가 ᅡ ﬁ 😀😀",
]


def test_encoder_equals_library():
    rng = random.Random(4)
    odd = ["".join(rng.choice("aZ's\"tré 9\n\tİ.!-<|>xll") for _ in range(60)) for _ in range(300)]
    texts = [t or "" for t in TEXTS] + odd
    encode = packing.tokenizer_encoder(WORD_BPE, 1)()
    library = Tokenizer.from_file(WORD_BPE)
    want = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert [x.tolist() for x in encode(texts)] == want
    assert [x.tolist() for x in encode(texts)] == want  # from what is remembered


def check_packing(pieces, docs, size):
    """Every id once, offsets without gaps, little padding. ``docs`` has ids by (doc_id, doc_tokens)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4")
        assert len(ids) == p.length > 0
        by_doc[p.doc_id].append((p.start, ids))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for key, ids in docs.items():
        own = sorted(by_doc.pop(key), key=lambda x: x[0])
        assert np.concatenate([x[1] for x in own]).tolist() == ids
        assert [x[0] for x in own] == np.cumsum([0, *(len(x[1]) for x in own)])[:-1].tolist()
    assert not by_doc
    rest = []
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        total = sum(n for _, n in own)
        assert total <= size
        if total < size:
            assert total & (total - 1) == 0
            rest.append(total)
    assert len(rest) == len(set(rest))


def test_packing_is_whole(spark):
    rng = random.Random(2)
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(["Word", "other", "é", "x1"]) for _ in range(rng.randrange(150)))) for i in range(200)]
    texts += [(1000, "many words " * 3000), (None, "nobody's")]
    frame = spark.createDataFrame([(i, t, 1, "s", b"i") for i, t in texts], "doc_id long, text string, length int, start string, ids binary").repartition(9)
    library = Tokenizer.from_file(WORD_BPE)
    docs = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    for size, windows, fan_in in ((64, 3, 2), (2048, 16, 16)):
        got = packing.pack(frame, packing.tokenizer_encoder(WORD_BPE, 1), size=size, windows=windows, fan_in=fan_in).collect()
        check_packing(got, docs, size)
        assert {p.doc_id: p.doc_tokens for p in got} == {i: len(x) for i, x in docs.items()}
    # documents that fit a window are mostly whole
    pieces = defaultdict(int)
    for p in got:
        pieces[p.doc_id] += 1
    assert sum(n > 1 for i, n in pieces.items() if len(docs[i]) <= 2048) <= 40


def test_packing_repeated_rows_and_none(spark):
    make = packing.tokenizer_encoder(WORD_BPE, 1)
    frame = spark.createDataFrame([(1, "same text")] * 7, "doc_id long, text string").repartition(3)
    got = packing.pack(frame, make).collect()
    assert sum(p.length for p in got) == 7 * got[0].doc_tokens
    assert packing.pack(frame.limit(0), make).count() == 0


# --- 3: state on disk ---


def test_state_of_many_partitions_takes_little_disk(spark, tmp_path):
    """Two hundred state partitions of few rows: disk follows the rows, not the partitions."""
    path, state = str(tmp_path / "docs"), tmp_path / "state"
    spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 300).cast("string").alias("text")).write.parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert exact_dedup.deduplicate(spark, path, state=str(state)).filter("kept").count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert exact_dedup.STREAM_SETTINGS["spark.sql.streaming.stateStore.rocksdb.allowFAllocate"] == "false"
    assert sum(f.stat().st_blocks * 512 for f in state.rglob("*") if f.is_file()) < 60 << 20


# --- word hashes ---


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_linear_relations_do_not_make_words_equal(spark):
    """A Thue-Morse word and its complement collide for every polynomial hash modulo a power of two."""
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [a, b, a + " x y z w", b + " x y z w", a[:64], b[:64], a[:61], b[:61]]
    raw = " ".join(texts).encode()
    hashes = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert len(set(hashes.tolist())) == 2 + 4 + 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs, slot_bits=10).collect()} == {i: i for i in range(8)}


def test_a_lot_of_texts_is_held_in_few_bytes_a_word(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from weblode.llm import kn_quality as kn

    class Value:
        def __init__(self, value):
            self.value = value

    class Context:
        @staticmethod
        def get():
            return type("Task", (), {"partitionId": lambda self: 3})()

    rng = np.random.default_rng(5)
    texts = [" ".join(map("w{}".format, rng.integers(0, 5000, 1000))) for _ in range(800)]
    hashes = np.unique(kn.words_of(np.frombuffer(" ".join(f"w{i}" for i in range(5000)).encode(), np.uint8), np.array([0, 28889]), lower=True)[0])
    vocabulary = kn.Vocabulary(hashes, np.arange(len(hashes), dtype=np.uint64) + np.uint64(6))
    shards = kn.Shards(8, np.ones(len(hashes) + 6, np.uint64))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(800)), "text": texts})
    monkeypatch.setattr(kn, "TaskContext", Context)
    task = kn._asked(Value(vocabulary), Value(shards), ["doc_id"], "text")
    list(task(iter([batch.slice(0, 8)])))  # tables of powers and codes are made once
    tracemalloc.start()
    words = np.zeros(800, np.int64)
    for row in task(iter([batch])):
        if row.column("kind")[0].as_py() == kn.ASKED:
            doc = kn._opened(row.column("doc")[0].as_py(), np.uint32).astype(np.int64)
            words += np.bincount(doc, kn._opened(row.column("n")[0].as_py(), np.uint32), 800).astype(np.int64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words.tolist() == [1000] * 800
    assert peak < 80 * 800_000


def changed_copies(n, words, changes):
    rng = random.Random(n)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(words), changes):
            own[at] = f"v{rng.randrange(10**6)}"
        yield own


@pytest.mark.parametrize(("n", "words", "changes", "near", "close"), [(80, 300, 8, 1600, 100), (200, 60, 1, 4000, 4000)])
def test_groups_of_changed_copies_make_few_pairs(spark, monkeypatch, n, words, changes, near, close):
    """Copies share most index keys, whether they are too unlike to link or nearly all link."""
    made = {}

    def counted(df, name, stored=ngram_join.stored):
        out = stored(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    copies = list(changed_copies(n, words, changes))
    sets = [{tuple(own[i : i + 4]) for i in range(len(own) - 3)} for own in copies]
    linked = [[j for j in range(n) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])] for i in range(n)]
    least, before = list(range(n)), None
    while least != before:
        before = least
        least = [min(least[j] for j in own) for own in linked]
    monkeypatch.setattr(ngram_join, "stored", counted)
    docs = spark.createDataFrame([(i, " ".join(own)) for i, own in enumerate(copies)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs, slot_bits=14).collect()} == dict(enumerate(least))
    assert made["join-pairs"] <= near and made["join-close"] <= close, made


def test_full_signatures_rule_nothing_out():
    many = np.arange(3000, dtype=np.uint64)  # all in the first range
    few = np.arange(1, 3000, dtype=np.uint64)
    full, other = ngram_join.signature(many), ngram_join.signature(few << np.uint64(50))
    assert ngram_join.ranges(full) == b"" and len(ngram_join.ranges(other)) == ngram_join.RANGES
    counts = ngram_join.counts_of([ngram_join.ranges(full), ngram_join.ranges(other)])
    found = ngram_join._candidates(1, np.array([1, 2]), np.zeros(2, np.int64), np.array([3000, 2999]), [counts], 85)
    assert found.tolist() == [0]
    assert ngram_join.may_be_similar(full, 3000, other, 2999, 85)
