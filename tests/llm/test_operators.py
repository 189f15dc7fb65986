"""Each operator against a plain version, on texts with nulls, empties, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.llm import chat_format, grid_join, jaccard_join, kneser_ney, mixing, quality_rules, sentence_pieces, sharding, suffix_tree, token_counts
from tessel.llm import components as components_module
from tessel.llm import tokens as T
from tessel.llm.components import components
from tessel.llm.scratch import fresh

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "\t x", "a", "A a", "é É", "x" * 3000, "a b c d e f g h " * 400, "🙂漢字 b", "▁ a▁", "<s> <0x41> \x00"]


def lower(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x or "")


def docs_of(spark, texts, **extra):
    """Rows in two partitions; extra columns have names that operators use themselves."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or ""), 0, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, node string").repartition(2)


@pytest.fixture(scope="module")
def some_texts():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(60)]
    return ODD + texts + texts[:9] + [texts[3].replace("w1", "W1")]


# words


def test_words_and_hashes(monkeypatch, some_texts):
    for block in (16, 1 << 20):
        monkeypatch.setattr(T, "BLOCK", block)
        data, offsets = T.text_bytes(pa.array(some_texts))
        t, seen = T.words(data, offsets, lower=True), {}
        for i, x in enumerate(some_texts):
            a, b = t.bounds[i], t.bounds[i + 1]
            assert [data[s:e].tobytes().decode() for s, e in zip(t.start[a:b], t.end[a:b], strict=True)] == WORD.findall(x or "")
            for w, h in zip(WORD.findall(lower(x)), t.hash[a:b].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
    data, offsets = T.text_bytes(pa.array(["zz"] + some_texts)[1:])
    assert len(offsets) == len(some_texts) + 1 and data.tobytes() == "".join(x or "" for x in some_texts).encode()


def test_order_and_distinct_are_those_of_numpy():
    r = np.random.default_rng(7)
    some = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = (some[:1] << np.uint64(1)) + r.integers(0, 50, 500, dtype=np.uint64)  # equal high bits
    for x in (some[:0], some[:1], np.zeros(5, np.uint64), some, np.repeat(some, 3), near, np.append(some, near), r.integers(0, 9, 99, dtype=np.uint64), ~some):
        places, out = T.order(x)
        assert (places == np.argsort(x, kind="stable")).all() and (out == np.sort(x)).all()
        assert all((a == b).all() for a, b in zip(T.distinct(x), np.unique(x, return_inverse=True), strict=True))


def test_places_are_found():
    r = np.random.default_rng(8)
    for keys in (np.zeros(0, np.int64), np.array([0]), np.unique(r.integers(0, 1 << 62, 5000)), np.arange(3000) << 21):
        asks = np.concatenate([keys, keys + 1, [-1, 0, 7]])
        want = {k: i for i, k in enumerate(keys.tolist())}
        assert T.Places(keys).find(asks).tolist() == [want.get(x, -1) for x in asks.tolist()]


# 1


def test_shards_commit_compact_and_sweep(spark):
    table = sharding.ShardedTable(spark, fresh(spark, "test"))
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    for part in range(4):
        table.append(df.filter(F.col("doc_id") % 4 == part).repartition(2), 100)
    before = table.current()
    assert before.version == 4 and len(before.shards) >= 40
    m = table.compact(target=1 << 20, fan_in=4)
    assert len(m.shards) < 10 and not sharding.plan(m.shards, 1 << 20, 4)
    assert sorted(table.read().collect()) == sorted(df.collect()) and table.read(1).count() == 1000
    stale = table.current()
    table.append(df.limit(0))
    with pytest.raises(sharding.CommitConflict):
        table._commit(stale, stale.schema, ())
    with pytest.raises(ValueError):
        table.append(df.select("text"))
    last = table.current().version
    table._folder.create(f"manifests/{last + 1:020d}.json", "")  # a manifest that a disk has torn
    for act in (table.current, lambda: table.append(df.limit(5))):
        with pytest.raises(sharding.DamagedManifest):
            act()
    assert table.recover() == last and table.append(df.limit(5)).version == last + 1
    pending = table._write(df.limit(7), 100)  # another writer's, before its commit
    assert table.sweep() > 0 and table.read().count() == 4005
    with pytest.raises(ValueError):
        table.read(1)
    now = table.current()
    table._commit(now, now.schema, now.shards + tuple(pending))
    assert table.read().count() == 4012
    table._write(df.limit(7), 100)
    assert table.sweep(grace=-60) > 0 and table.read().count() == 4012


def test_of_two_writers_of_shards_one_fails_and_no_row_is_lost(spark, monkeypatch):
    """One writer is held between writing its manifest and publishing it."""
    root = fresh(spark, "test")
    a, b = sharding.ShardedTable(spark, root), sharding.ShardedTable(spark, root)
    df = spark.createDataFrame([(1, None), (1, None), (None, "x" * 100_000)], "doc_id long, text string")
    a.append(df)
    create = type(a._folder).create

    def held(folder, name, text):
        if folder is a._folder:
            assert b.append(df).version == 2  # the other one is whole meanwhile
        return create(folder, name, text)

    monkeypatch.setattr(type(a._folder), "create", held)
    with pytest.raises(sharding.CommitConflict):
        a.append(df)
    assert a.current().version == 2 and a.read().count() == 6


def test_tiers():
    s = lambda *sizes: tuple(sharding.Shard(f"{i}", b) for i, b in enumerate(sizes))
    assert sharding.plan(s(*[1000] * 7), 1 << 20, 8) == [] and len(sharding.plan(s(*[1000] * 8), 1 << 20, 8)) == 1
    assert sharding.plan(s(*[1 << 20] * 50), 1 << 20, 8) == []
    assert [len(g) for g in sharding.plan(s(*[1000] * 8, *[400_000] * 9), 1 << 20, 8)] == [8, 9]


def test_shards_of_an_empty_table(spark):
    table = sharding.ShardedTable(spark, fresh(spark, "test"))
    with pytest.raises(ValueError):
        table.read()
    table.append(spark.createDataFrame([], "doc_id long"))
    assert table.compact().version >= 1 and table.read().count() == 0


# 2


def plain_tree(texts, train, min_word, min_context, min_entry, divergence, max_depth, min_count, gain):
    """Counts, states and probabilities by dictionaries, one token at a time."""
    tokens, begin = {i: WORD.findall(lower(x)) + ["\n"] for i, x in texts.items()}, "\n^"
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    root = {w: (m + 0.1) / (n + 0.1 * (v + 1)) for w, m in c.items()}
    unseen = 0.1 / (n + 0.1 * (v + 1))
    frequent = {w for w, m in c.items() if m >= max(1.0, min_word * n)}
    flat = (1 - sum(root[w] for w in frequent)) / (v - len(frequent) + 1)
    context = lambda ws, j, k: tuple(([begin] + ws)[j + 1 - k : j + 1]) if k <= j + 1 else None
    after = defaultdict(Counter)
    for i in train:
        for j, w in enumerate(tokens[i]):
            for k in range(1, max_depth + 3):
                if (x := context(tokens[i], j, k)) is not None:
                    after[x][w] += 1
    hot = {x for x, s in after.items() if len(x) <= max_depth and set(x) <= frequent | {begin} and sum(s.values()) >= max(2.0, min_context * n)}
    states = {}

    def p(x, w, base):
        """P(w | x) mixed down from x's longest retained suffix to base(w)."""
        if not x:
            return base(w)
        if x not in states:
            return p(x[1:], w, base)
        share, rest = states[x]
        return share.get(w, 0.0) + rest * p(x[1:], w, base)

    by_root = lambda w: root.get(w, unseen)
    for x in sorted(hot, key=len):
        size = sum(after[x].values()) + 1.0
        share = {w: m / size for w, m in after[x].items() if w in frequent and m >= max(1.0, min_entry * n)}
        rest = 1 - sum(share.values())
        if sum(q * math.log(q / p(x[1:], w, by_root) + rest) for w, q in share.items()) + rest * math.log(max(rest, 1e-300)) >= divergence:
            states[x] = (share, rest)
    flattened = lambda w: root[w] if w in frequent else flat
    depth = lambda x: max((k for k in range(len(x) + 1) if not k or x[-k:] in hot))
    for x in sorted(set(after) - hot, key=len):
        h = depth(x)
        if h < max_depth and len(x) - h <= 2 and (len(x) - h == 1 or sum(after[x[1:]].values()) >= min_count):
            total, types = sum(after[x].values()), len(after[x])
            gains = 0.0
            for w, m in after[x].items():
                below, left = p(x[1:], w, flattened), types - (m == 1)
                if total > 1:
                    gains += m * math.log(max((m - 1 + left * below) / max(total - 1 + left, 1) / below, 1e-300))
            if total >= min_count and gains >= gain:
                states[x] = ({w: m / (total + types) for w, m in after[x].items()}, types / (total + types))

    def score(i):
        out = 0.0
        for j, w in enumerate(tokens[i]):
            x = max((y for k in range(max_depth + 3) if (y := context(tokens[i], j, k)) is not None and (not k or len(y) <= depth(y) + 2 and (y in hot or depth(y) < max_depth))), key=len)
            out += math.log10(p(x, w, by_root))
        return out

    return tokens, c, root, unseen, states, score, hot, p, by_root


@pytest.mark.parametrize("min_word", [2.0**-20, 0.01])
def test_suffix_tree_counts_states_and_scores(spark, monkeypatch, some_texts, min_word):
    monkeypatch.setattr(suffix_tree, "MIN_WORD", min_word)
    texts = dict(enumerate(some_texts + ["^ begin", "q r s t u v w", "q r s t u v w", "zz q r s t unseen"]))
    # null and repeated ids are rows of their own
    rows = [(i if i != 20 else None, t) for i, t in texts.items()]
    held = {i: zlib.crc32((str(i) if i != 20 else "").encode()) % 10 == 0 for i in texts}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", suffix_tree.split(F.col("doc_id"))).repartition(2)
    docs = suffix_tree.save(docs, "test")
    counts = suffix_tree.word_counts(docs.filter("not held_out"))
    tree = suffix_tree.grow(docs.filter("not held_out"), counts, min_context=0.005, min_entry=0.001, divergence=0.0)
    got = {r.doc_id: r for r in suffix_tree.score(docs, tree, counts).collect()}
    train = [i for i in texts if not held[i]]
    tokens, c, root, unseen, states, score, hot, p, by_root = plain_tree(texts, train, min_word, 0.005, 0.001, 0.0, 3, 2, 1.0)
    n, z = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    assert len(got) == len(texts) and sum(len(x.context) for x in tree.levels) == len(hot)
    for i, ws in tokens.items():
        r = got[i if i != 20 else None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / z) for w in ws))
        assert r.score == pytest.approx(score(i), rel=1e-6)
    deep = Counter(len(x) for x in states)
    assert deep[1] > 5 and deep[2] > 5 and deep[3] > 3 and any(x not in hot for x in states)
    for x in list(states)[:: max(1, len(states) // 40)]:  # every distribution sums to one
        if x in hot or min_word < 0.001:
            assert sum(p(x, w, by_root) for w in c) + p(x, "never seen", by_root) == pytest.approx(1.0)


def test_packed_blocks_come_back():
    rng = np.random.default_rng(4)
    n = 5000
    word = rng.integers(0, 300, n).astype(np.uint64)
    b = suffix_tree.Block(rng.integers(0, 1 << 46, n // 4).astype(np.uint64).repeat(4), rng.integers(0, 9, n // 4).astype(np.uint64).repeat(4), rng.integers(0, 1 << 23, n).astype(np.uint64), word, rng.integers(0, 1 << 63, (word == 0).sum()).astype(np.uint64), rng.integers(0, 2000, n).astype(np.uint64))
    rows = lambda x, w: sorted(zip(x.key.tolist(), x.code.tolist(), x.deep.tolist(), x.word.tolist(), x.row.tolist(), w, strict=True))

    def rare(x):
        left = iter(x.rare.tolist())
        return [next(left) if not w else 0 for w in x.word.tolist()]

    out = []
    for part, blob in b.packed(7):
        x = suffix_tree.Block.unpacked(blob)
        assert 0 <= part < 7 and (np.diff(x.key.astype(np.int64)) >= 0).all()
        out += rows(x, rare(x))
    assert sorted(out) == rows(b, rare(b))


def test_suffix_tree_beats_the_base_on_held_out_text(spark):
    out = suffix_tree.op2_suffix_tree(spark, "/root/testdata/sf0.1").groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"))
    r = {x.held_out: x.s / x.b for x in out.collect()}
    print(r)
    assert r[True] < 0.9 and r[False] < r[True]


def test_suffix_tree_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    counts = suffix_tree.word_counts(empty)
    tree = suffix_tree.grow(empty, counts)
    assert suffix_tree.score(empty, tree, counts).count() == 0
    one = spark.createDataFrame([(1, "a b", True)], empty.schema)
    r = suffix_tree.score(one, tree, counts).first()
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (3, 0, 0.0, 0.0)


# 3


def test_chat_examples(spark):
    nasty = r"a<|im_end|>b<\|c<\\|im_start|>" + "\n\\"
    rows = [(1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", "one<"), (1, 3, "user", None), (1, 4, "assistant", nasty), (1, 5, "user", "tail"), (2, 0, "user", "x"), (3, 0, "assistant", ""),
            (None, 0, "assistant", "n"), (4, 1, "assistant", "dup"), (4, 1, "assistant", "dup"), (4, None, "a\nb\\b|<|", "r"), (5, 0, None, "é🙂")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit(1)).repartition(3)
    ex = chat_format.examples(turns)
    got = {r.conv_id: r for r in chat_format.digests(ex).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((-1 if t is None else t, role or "", text or ""))
    each = defaultdict(list)
    for r in ex.collect():
        each[r.conv_id].append(r)
    for c, ts in convs.items():
        ts.sort()
        loss = [x for _, role, x in ts if role == "assistant"]
        r = got[c]
        assert r.n_turns == len(ts) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in ts).encode()).hexdigest()
        assert r.loss_chars == len("".join(loss)) and r.loss_sha256 == hashlib.sha256("".join(loss).encode()).hexdigest()
        assert r.formatted_chars == sum(len(e.text) for e in each[c])
        assert len(each[c]) == len(loss) + (ts[-1][1] != "assistant")
        for e in each[c]:
            assert e.text.count("<|im_end|>\n") == e.n_turns and e.text.count("<|im_start|>") == e.n_turns
    assert chat_format.digests(chat_format.examples(turns.limit(0))).count() == 0


# 4


def components_of(sets, ids, linked):
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    low = {}
    for a, i in enumerate(ids):
        low[find(a)] = min(low.get(find(a), i), i)
    return {i: low[find(a)] for a, i in enumerate(ids)}


def shingles(x, k):
    w = WORD.findall(lower(x))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "percent", "tile", "block"), [(3, 90, 4096, 1 << 21), (5, 80, 3, 300), (2, 50, 4096, 200)])
def test_jaccard_join_loses_and_adds_nothing(spark, monkeypatch, some_texts, k, percent, tile, block):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HUBS", 2)
    r, texts = random.Random(k), list(some_texts)
    for base in [t for t in some_texts if t and 10 < len(t.split()) < 70][:12]:
        for _ in range(4):
            words = base.split()
            for _ in range(r.randint(1, max(1, len(words) // 20))):
                words[r.randrange(len(words))] = f"w{r.randrange(40)}"
            texts.append("  ".join(words))
    sets = [shingles(t, k) for t in texts]
    want = components_of(sets, list(range(len(texts))), lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b))
    got = {x.doc_id: x for x in jaccard_join.classes(docs_of(spark, texts), k, percent).collect()}
    assert {i: x.component_id for i, x in got.items()} == want
    assert all(got[i].n_shingles == len(s) for i, s in enumerate(sets)) and len(set(want.values())) < len(want) - 10


def test_one_of_each_group_stays_with_its_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = docs_of(spark, [text, text + " x", None, "", text, "a b"])
    kept = jaccard_join.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5] and kept.columns == docs.columns
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(components_module, "FEW", few)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    want = components_of(list(range(2100)), list(range(2100)), lambda a, b: (a, b) in linked or (b, a) in linked) if (linked := set(edges)) else {}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}


# 5


def test_poisson_replication(spark):
    docs = docs_of(spark, ["t"] * 4000)
    out = mixing.replicate(docs, {"s0": 1.0, "s1": 3.0, "": 0.0}, expansion=1.5)
    rows = out.collect()
    n = Counter(r.source for r in rows)
    assert abs(n["s0"] - 1500) < 200 and abs(n["s1"] - 4500) < 300 and None not in n
    assert [r["_place"] for r in rows] == sorted(r["_place"] for r in rows)
    assert rows == mixing.replicate(docs, {"s0": 1.0, "s1": 3.0}, expansion=1.5).collect()
    rate = 3 / 4 * 1.5 * 4000 / docs.filter("source = 's1'").count()
    copies = Counter(r.doc_id for r in rows if r.source == "s1")
    for i in (r.doc_id for r in docs.filter("source = 's1'").select("doc_id").collect()[:200]):
        u, k, p = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        assert copies[i] == k
    assert mixing.replicate(docs.limit(0)).count() == 0 and mixing.replicate(docs, {}).count() == 0
    big = spark.range(1).select(mixing.cumulative(F.lit(900.0)).alias("c")).first().c
    assert big[-1] == pytest.approx(1.0) and big[899] == pytest.approx(0.5, abs=0.02)


# 6


def test_grid_join(spark, monkeypatch):
    rng, rows = np.random.default_rng(2), []
    for c in range(12):
        base = rng.normal(size=12)
        rows += [(base + rng.normal(size=12) * rng.choice([0, 0.02, 0.1, 0.4]), int(c % 2)) for _ in range(30)]
    rows = [(x.astype(np.float32).tolist(), label) for x, label in rows]
    rows += [(None, 1), ([], 1), ([0.0] * 12, 1), ([float("nan")] * 12, 1), ([None] + [1.0] * 11, 1), ([1.0] * 12, None), ([1.0] * 5, 1), ([2.0] * 5, 1), ([float("inf")] * 12, 0), ([1e-30] * 12, 0), ([3e-30] * 12, 0)]
    df = spark.createDataFrame([(i, x, label) for i, (x, label) in enumerate(rows)], "vec_id long, embedding array<float>, label int").withColumn("dim", F.lit("x")).repartition(3)
    unit = []
    for x, label in rows:
        v = np.array([np.nan if y is None else y for y in (x if x is not None else [np.nan])], np.float32).astype(float)
        unit.append((label, v / np.linalg.norm(v)) if label is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    linked = lambda a, b: a is not None and b is not None and a[0] == b[0] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.98
    want = components_of(unit, list(range(len(rows))), linked)
    n = [sum(linked(a, b) for j, b in enumerate(unit) if i != j) for i, a in enumerate(unit)]
    for block, leaf, fan in ((1024, 64, 4), (20, 3, 4), (4, 3, 2)):
        monkeypatch.setattr(grid_join, "BLOCK", block)
        monkeypatch.setattr(grid_join, "LEAF", leaf)
        monkeypatch.setattr(grid_join, "FAN", fan)
        got = {r.vec_id: r for r in grid_join.near_duplicates(df).collect()}
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], want[i], want[i] == i) for i in want}
    assert grid_join.near_duplicates(df.limit(0)).count() == 0


def test_intervals_of_copies_are_linked_without_their_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(3, 8))
    rows = [base[c] + rng.normal(size=8) * 0.001 for c in (0, 1, 2) for _ in range(150)] + list(rng.normal(size=(60, 8)))
    df = spark.createDataFrame([(i, x.tolist(), "x") for i, x in enumerate(rows)], "vec_id long, embedding array<double>, label string").repartition(2)
    monkeypatch.setattr(grid_join, "BLOCK", 2)
    monkeypatch.setattr(grid_join, "FAN", 2)
    met = []
    joined = grid_join._joined
    monkeypatch.setattr(grid_join, "_joined", lambda pairs, *rest: met.append(pairs.count()) or joined(pairs, *rest))
    got = {r.vec_id: (r.n_links, r.component_id) for r in grid_join.near_duplicates(df).collect()}
    unit = [x / np.linalg.norm(x) for x in rows]
    linked = lambda a, b: a @ b >= 0.98
    want = components_of(unit, list(range(len(rows))), linked)
    cosines = np.array(unit) @ np.array(unit).T >= 0.98
    assert got == {i: (int(cosines[i].sum()) - 1, want[i]) for i in want}
    # 75 blocks of each group would meet in 2,850 pairs
    assert met[0] < 1500


# 7


def base_counts(x):
    x = x or ""
    w, seen, dup, cover = WORD.findall(x), set(), 0, set()
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    for i in range(len(w) - 7):
        if runs[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, len(cover)


def test_line_quality_counts(spark, some_texts):
    texts = some_texts + ["a\nb\na\n a\na \na\t\na", "x | y\n" * 30, "\n".join("one two three four five six seven eight nine".split() * 3)]
    for r in quality_rules.assess(docs_of(spark, texts), None).collect():
        n = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert n == base_counts(texts[r.doc_id])
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and r.kept == (not r.base_failed)


def test_viterbi_and_gradient_against_enumeration():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 5, 5, 6, 13])
    x = rng.random((13, 3)) < 0.5
    crf = quality_rules.Crf(rng.normal(size=3), rng.normal(size=(2, 2)))
    got = crf.viterbi(x, bounds)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        score = lambda y, a=a: sum((x[a + i] @ crf.weights) * v for i, v in enumerate(y)) + sum(crf.moves[p, q] for p, q in zip(y, y[1:], strict=False))
        every = [[n >> i & 1 for i in range(b - a)] for n in range(1 << (b - a))]
        assert score(got[a:b].astype(int).tolist()) == pytest.approx(max(map(score, every)))
    y = np.zeros(13, int)
    y[5:] = 1
    x[:, 0] = y
    fitted = quality_rules.fit(x, bounds, y)
    assert (fitted.viterbi(x, bounds) == y).all()


def test_line_quality_verdicts_on_labelled_text(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    crf = quality_rules.train(docs, labels)
    r = quality_rules.assess(docs, crf).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {x.quality: x.kept for x in r}
    assert share[1] > 0.97 and share[0] < 0.2  # 28 documents of the latter
    kept = quality_rules.keep(docs, crf)
    assert kept.schema == docs.schema and kept.count() == quality_rules.assess(docs, crf).filter("kept").count()
    assert quality_rules.train(docs, labels.limit(0)) is None and quality_rules.assess(docs.limit(0), crf).count() == 0


# 8


def greedy(word, pieces):
    n = 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not size:
            return 0
        word, n = word[size:], n + 1
    return n


def test_automaton_counts_greedy_pieces(spark, some_texts):
    r = random.Random(0)
    for _ in range(200):
        pieces = {bytes([r.choice(b"ab "), *(r.choice(b"ab") for _ in range(r.randint(0, 4)))]) for _ in range(r.randint(1, 8))}
        a = token_counts.build(sorted(pieces))
        for _ in range(30):
            w = b" " + bytes(r.choice(b"ab") for _ in range(r.randint(1, 9)))
            assert a.count(w) == greedy(w, pieces)
    pieces = token_counts.read_vocabulary()
    a = token_counts.build(pieces)
    pieces = {p for p in pieces if not any(T.SEPARATOR[b] for b in p[1:])}
    for x in token_counts.count_tokens(docs_of(spark, some_texts), a).collect():
        w = WORD.findall(some_texts[x.doc_id] or "")
        assert (x.n_words, x.n_tokens, x.n_unknown) == (len(w), sum(greedy(b" " + v.encode(), pieces) for v in w), 0)
    small = token_counts.build([b" a", b"b"])
    x = token_counts.count_tokens(spark.createDataFrame([(1, "ab abb c")], "doc_id long, text string"), small).first()
    assert (x.n_tokens, x.n_unknown) == (2 + 3 + 1, 1)


# 9


def plain_model(texts):
    c3 = Counter()
    for t in texts:
        w = ["<", "<", *WORD.findall(lower(t)), ">"]
        c3.update(tuple(w[i - 2 : i + 1]) for i in range(2, len(w)))
    c2 = Counter(g[1:] for g in c3)
    levels = [Counter(g[1:] for g in c2), c2, c3]

    def discounts(c):
        n1, n2, n3, n4 = (Counter(c.values())[i] for i in range(1, 5))
        if not n1 or not n2:
            return [0.5] * 3
        y = n1 / (n1 + 2 * n2)
        return [min(max(d, 0.05), i + 0.95) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5))]

    ds = [discounts(c) for c in levels]
    by = [defaultdict(list) for _ in levels]
    for c, b in zip(levels, by, strict=True):
        for g, n in c.items():
            b[g[:-1]].append(n)

    def p(k, g):
        below = 1 / (len(levels[0]) + 1) if k == 0 else p(k - 1, g[1:])
        seen = by[k].get(g[:-1])
        if not seen:
            return below
        off = lambda n: ds[k][min(n, 3) - 1]
        n = levels[k].get(g, 0)
        return (n - off(n) if n else 0) / sum(seen) + sum(map(off, seen)) / sum(seen) * below

    def log_p(t):
        w = ["<", "<", *WORD.findall(lower(t)), ">"]
        return sum(math.log(p(2, tuple(w[i - 2 : i + 1]))) for i in range(2, len(w)))

    return log_p


def test_labeller_sees_long_pages_when_characters_are_cut(spark, monkeypatch):
    """Half of the characters for each label, in hash order: neither the longest nor a whole label goes."""
    texts = [("word " * (10 + 10 * (i % 10)) + "\n") for i in range(60)] + [("longer " * 400 + "\n")] * 60
    docs = docs_of(spark, texts)
    labels = docs.select("doc_id", (F.col("doc_id") >= 60).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(quality_rules, "fit", lambda x, bounds, y: seen.append(y))
    quality_rules.train(docs, labels, max_chars=20_000)
    assert set(seen[0]) == {0, 1}
    quality_rules.train(docs, labels, max_chars=1_000)  # less than one text of label 1
    assert set(seen[1]) == {0, 1}
    with pytest.warns(UserWarning):
        assert quality_rules.train(docs, labels.filter("quality = 0")) is None


def test_kneser_ney_is_exact(spark, some_texts):
    train = some_texts[::2]
    model = kneser_ney.train(docs_of(spark, train), 3)
    log_p = plain_model(train)
    for r in kneser_ney.score(docs_of(spark, some_texts), model, ["doc_id"]).collect():
        assert r.log_prob == pytest.approx(log_p(some_texts[r.doc_id])) and r.n_words == len(WORD.findall(some_texts[r.doc_id] or ""))
    assert kneser_ney.train(docs_of(spark, train).limit(0), 3) is None


def test_classifier_keeps_trusted_and_rejects_symbols(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    c = kneser_ney.fit(docs, labels)
    out = kneser_ney.assess(docs, c).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id")
    assert out.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.98
    assert out.filter("text like '%$$$ %### %' or text like '%!! %!! %!! %!! %!! %'").filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.2
    kept = kneser_ney.keep(docs, c)
    assert kept.schema == docs.schema and kept.count() == kneser_ney.assess(docs, c).filter("kept").count()
    none = kneser_ney.fit(docs, labels.limit(0))
    assert none is None and kneser_ney.keep(docs, None).count() == docs.count() and kneser_ney.assess(docs, None).filter("kept").count() == docs.count()
    odd = docs_of(spark, ODD)
    assert kneser_ney.assess(odd, c).count() == len(ODD)


def test_kneser_ney_trains_on_all_trusted_text_within_the_bound(spark, monkeypatch):
    """No more is cut than the stated 5,000 documents and 24 million characters."""
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.repeat(F.lit("word "), 1000)).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    seen = []
    monkeypatch.setattr(kneser_ney, "train", lambda rows, order: seen.append(rows.count()))
    kneser_ney.fit(docs, labels)
    assert 3500 < seen[0] == docs.filter("pmod(xxhash64(doc_id), 2) = 0").count() < 4500


def test_kneser_ney_skips_a_text_beyond_the_bound_and_no_others(spark, monkeypatch):
    texts = ["word " * 20] * 40
    plain = docs_of(spark, texts)
    ids = [r.doc_id for r in plain.filter("pmod(xxhash64(doc_id), 2) = 0").collect()]
    docs = docs_of(spark, ["word " * 20_000 if i == ids[0] else x for i, x in enumerate(texts)]).withColumn("lang", F.lit("en"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    seen, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda rows, order: seen.append(sorted(r._id for r in rows.collect())) or train(rows, order))
    kneser_ney.fit(docs, labels, max_chars=10_000)
    assert seen[-1] == sorted(ids[1:])
    one = docs.filter(F.col("doc_id") == ids[0])
    assert kneser_ney.fit(one, labels, max_chars=10) is not None  # the only text, however long

    scores, save = [], kneser_ney.save
    monkeypatch.setattr(kneser_ney, "save", lambda df, name, *by: scores.append(df.select("_id").collect()) or df if name == "trusted" else save(df, name, *by))
    kneser_ney.fit(docs, labels, max_docs=2)
    assert {r[0] for r in scores[-1]} == set(range(40)) - set(seen[-1]) and len(seen[-1]) == 2


def test_kneser_ney_trains_on_whole_halves_beyond_any_bound(spark, monkeypatch):
    """More than 5,000 documents, more than 24 million characters in one of them: each is counted."""
    n, long = 11_000, 25_000_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    first = docs.filter("pmod(xxhash64(doc_id), 2) = 0").first().doc_id
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("x" * 49 + " "), long // 50)).otherwise(F.col("text")))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    seen = []
    monkeypatch.setattr(kneser_ney, "train", lambda rows, order: seen.append(rows.agg(F.count("*"), F.sum(F.length("text"))).first()))
    kneser_ney.fit(docs, labels)
    half = docs.filter("pmod(xxhash64(doc_id), 2) = 0")
    assert seen[0] == half.agg(F.count("*"), F.sum(F.length("text"))).first() and seen[0][0] > 5000 and seen[0][1] > 24_000_000


def test_kneser_ney_is_exact_in_rounds_and_parts(spark, some_texts, monkeypatch):
    """Of a table in partitions, of one that comes from a shuffle, of orders 2 and 4."""
    monkeypatch.setattr(kneser_ney, "SMALL", 0)
    train = some_texts[::2]
    log_p = plain_model(train)
    model = kneser_ney.train(docs_of(spark, train).repartition(3), 3)
    assert model.rounds == kneser_ney.ROUNDS and len(model.entries) == 1 + kneser_ney.PARTS
    for docs in (docs_of(spark, some_texts), docs_of(spark, some_texts).repartition(5)):
        got = kneser_ney.score(docs, model, ["doc_id"]).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(some_texts)))
        for r in got:
            assert r.log_prob == pytest.approx(log_p(some_texts[r.doc_id]), rel=1e-9) and r.n_words == len(WORD.findall(some_texts[r.doc_id] or ""))
    # all continuations of a context, the unseen word among them, have a probability of 1 together
    texts = ["a b a c b a", "b a c", None, "c c a b"]
    for order in (2, 4):
        model = kneser_ney.train(docs_of(spark, texts), order)
        got = {r.doc_id: r.log_prob for r in kneser_ney.score(docs_of(spark, ["a", "b", "c", "", "zz"]), model, ["doc_id"]).collect()}
        assert 0 < sum(map(math.exp, got.values())) < 1 and got[4] < min(got[i] for i in range(3))


# 10


def test_pieces_are_those_of_the_models_own_encoder(spark, monkeypatch, some_texts):
    import sentencepiece

    monkeypatch.setattr(sentence_pieces, "ID_RUN", 50)
    v = sentence_pieces.read_model()
    own = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    r = random.Random(6)
    texts = some_texts + ["  a   b\n\n c\td    ", "\n", " " * 40 + "x", "aaaa aaaaaaa " + "ab" * 30, "ſtraße 漢漢字 é" * 5, "the  therefore\u00a0 the\u2581thing"]
    texts += ["".join(r.choice(" \n\taeiounrst漢é🙂") for _ in range(r.randint(1, 60))) for _ in range(300)]
    texts += [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = docs_of(spark, texts)
    encoded = sentence_pieces.encode(docs, v)
    back = {x.doc_id: x for x in sentence_pieces.with_text(encoded, v).collect()}
    for i, x in enumerate(texts):
        assert back[i].text == (x or "")
        if "\u2581" not in (x or ""):  # the marker itself is told from a blank, by its bytes
            assert list(back[i].ids) == own.encode(x or "")
    assert back[0].ids == []
    assert sorted(sentence_pieces.encode(docs, v, read_back=True).collect(), key=str) == sorted(back.values(), key=str)
    assert sentence_pieces.with_text(sentence_pieces.encode(docs.limit(0), v), v).count() == 0
    twice = sentence_pieces.with_text(encoded.withColumn("text", F.lit("x")), v).first()
    assert twice.text == "x" and twice.text_ is not None
