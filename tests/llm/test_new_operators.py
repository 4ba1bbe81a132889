"""Operators 11 to 13 against plain loops and full decompositions; awkward rows for each."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import queries, sharding, trie, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, node string, d string"


# ---- 13


def loop_trie(rows):
    """The contract, conversation by conversation."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, int(c - np.fmod(c, 20))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        spare = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += spare
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def spark_trie(df):
    got = trie.prefix_trie(df, shared_heads=True)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in names) for r in got.collect())


def talk(seed, convs, deepest, words=("a b", "c", "", None, "d\te é", "x" * 3)):
    rng, rows = random.Random(seed), []
    for c in convs:
        for t in range(rng.randint(1, deepest)):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(words), "n", "d"))
    return rows


def test_trie_equals_the_loop(spark):
    rows = talk(1, [*range(100), 2**40 + 3, -7, -20, -41, 777, 1000], 6)
    rows += [(None, 0, "user", "lost", "n", "d"), rows[0], rows[0], (5, None, None, None, None, None)]
    df = spark.createDataFrame(rows, TURNS)
    assert spark_trie(df) == loop_trie(rows)
    assert spark_trie(df.repartition(3)) == loop_trie(rows)
    assert trie.prefix_trie(df.limit(0)).collect() == []


def test_trie_rolls_up_over_several_bands(spark, monkeypatch):
    monkeypatch.setattr(trie, "BAND", 3)
    monkeypatch.setattr(trie, "CHUNK", 4)
    monkeypatch.setattr(trie, "BLOCK", 5)
    rng, rows = random.Random(2), []
    for c in range(120):
        for t in range(rng.choice([1, 3, 9, 27, 28, 40, 82])):
            rows.append((c, t, "u", "same words" if t < 30 or rng.random() < 0.9 else rng.choice("xy"), "n", "d"))
    assert spark_trie(spark.createDataFrame(rows, TURNS)) == loop_trie(rows)


def test_trie_of_one_long_conversation_and_of_copies(spark):
    rows = [(40, t, "u", f"w {t % 7}", "n", "d") for t in range(6000)] + [(c, 0, "u", "long " * 50_000 if c % 20 == 0 else "hi", "n", "d") for c in range(60, 6060)]
    assert sum(r[0] == 40 for r in rows) * 2 == len(rows)
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS), shared_heads=True)
    top = got.filter("depth = 0").first()
    assert top.n_convs == 6001 and got.agg(F.max("depth")).first()[0] == 6000
    want = loop_trie([r for r in rows if r[0] != 40])  # conversation 40 shares no head with the others
    rest = sorted(tuple(r)[:8] for r in got.filter("depth > 0 AND conv_id <> 40").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())
    assert [(*r[:2], *r[3:]) for r in rest] == [(*r[:2], *r[3:]) for r in want if r[1]]
    chain = {r.depth: (r.n_leaves, r.n_convs) for r in got.filter("conv_id = 40 AND depth > 0").collect()}
    assert len(chain) == 6000 and set(chain.values()) == {(1, 1)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_trie_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    found = con.execute(trie.ORACLE)
    names = [d[0] for d in found.description]
    got = queries.op13_prefix_trie(spark, f"/root/testdata/{sf}")
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(found.fetchall(), key=str)


# ---- 11


def loop_best_fit(sizes, capacity):
    """Best fit decreasing, group by group, over a plain list."""
    rooms, at = [], []
    for s in sizes:
        fit = min(((r, i) for i, r in enumerate(rooms) if r >= s), default=None)
        if fit is None:
            rooms.append(max(capacity, s))
            fit = (rooms[-1], len(rooms) - 1)
        rooms[fit[1]] -= s
        at.append(fit[1])
    return at


def test_best_fit_equals_the_loop():
    for seed in range(60):
        rng = random.Random(seed)
        sizes = sorted((rng.choice([rng.randint(1, 30), rng.randint(1, 200), 17]) for _ in range(rng.randint(1, 300))), reverse=True)
        classes = sorted(Counter(sizes).items(), reverse=True)
        capacity = rng.randint(1, 400)
        runs, used = sharding.best_fit(classes, capacity)
        got = [b for place, n, b in runs for _ in range(n)]
        assert [place for place, _, _ in runs] == [sum(n for _, n, _ in runs[:i]) for i in range(len(runs))]
        loads = Counter()
        for s, b in zip(sizes, got):
            loads[b] += s
        assert all(v <= max(capacity, max(sizes)) for v in loads.values()) and used == len(loads)
        # groups of one size are alike, so bins agree as multisets of sizes
        want = Counter()
        for s, b in zip(sizes, loop_best_fit(sizes, capacity)):
            want[b] += s
        assert sorted(loads.values()) == sorted(want.values())


def test_bins_are_a_search_tree():
    rng, bins, plain = random.Random(3), sharding.Bins(), []
    for i in range(3000):
        if rng.random() < 0.6:
            plain.append((rng.randint(1, 50), i))
            bins.put(*plain[-1])
        else:
            least = rng.randint(1, 60)
            want = min((x for x in plain if x[0] >= least), default=None)
            assert bins.take(least) == want
            plain = [x for x in plain if x != want]

    def depth(node):
        return 0 if node is None else 1 + max(depth(node[2]), depth(node[3]))

    assert depth(bins.root) < 40


DOCS = "doc_id long, text string, shard string, key string, size string"


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 400) + str(i) for i in range(3000)] + ["copy " * 40] * 900 + [None, "", None] + ["é" * 3000]
    df = spark.createDataFrame([(i, t, "s", "k", "z") for i, t in enumerate(texts)] + [(0, texts[0], "s", "k", "z"), (None, "y", "s", "k", "z")], DOCS)
    got = sharding.report(df, 8).collect()
    assert len(got) == len(texts) + 2 and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    by_id = dict(enumerate(texts)) | {None: "y"}
    for r in got:
        text = by_id[r.doc_id] or ""
        assert r["size"] == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[text].add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # the copies outweigh a shard, so they have one; the others differ by a thousandth at most
    hot = where["copy " * 40].pop()
    assert load[hot] == 900 * 216 and sorted(load) == list(range(8))
    rest = [v for s, v in load.items() if s != hot]
    assert max(rest) - min(rest) <= max(rest) / 1000
    assert sharding.report(df.limit(0)).collect() == []
    few = sharding.report(df.filter("doc_id in (1, 2)"), 8).collect()
    assert sorted(r.shard for r in few) == [0, 1] and {r.slot for r in few} == {0}


def test_shards_of_a_capacity(spark, tmp_path):
    df = spark.createDataFrame([(i, "w" * (i % 90), "en") for i in range(2000)], "doc_id long, text string, lang string")
    got = sharding.assign(df, capacity=30_000).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    total = sum(r.b for r in got)
    # all groups are indivisible copies (22 or 23 rows each): no shard overflows, and few are wasted
    assert max(r.b for r in got) <= 30_000 and len(got) <= -(-total // 30_000) + 1
    sharding.write(df, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.drop("shard").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        sharding.assign(df)


# ---- 12


def scatter(values, basis):
    return basis @ np.diag(values) @ basis.T


def test_rank_one_updates_equal_a_full_decomposition():
    rng = np.random.default_rng(5)
    for d in (1, 2, 7, 40):
        for kind in range(5):
            values, basis = np.zeros(d), np.eye(d)
            rows = rng.normal(size=(3 * d + 5, d)) * 10.0 ** rng.integers(-4, 4, d)
            if kind == 1:
                rows = np.repeat(rows[: d // 2 + 1], 3, axis=0)  # fewer directions than dimensions
            if kind == 2:
                rows = np.eye(d)[rng.integers(0, d, 3 * d)]  # equal eigenvalues
            if kind == 3:
                rows[:, 0] = 0
            if kind == 4:
                rows = np.round(rows) + np.eye(d)[0] * 1e6
            for y in rows:
                values, basis = whitening.update(values, basis, y)
            want, top = rows.T @ rows, np.linalg.eigvalsh(rows.T @ rows)
            assert np.allclose(basis.T @ basis, np.eye(d), atol=1e-9)
            assert np.allclose(scatter(values, basis), want, atol=1e-10 * max(1e-300, top[-1]))
            assert np.allclose(values, top, atol=1e-10 * max(1e-300, top[-1]))


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(6)
    for _ in range(200):
        m = int(rng.integers(1, 30))
        d = np.sort(rng.choice([rng.random(m), np.cumsum(10.0 ** rng.integers(-12, 3, m))][int(rng.integers(2))], m, replace=False))
        d += np.arange(m) * 1e-9
        z = rng.normal(size=m) * 10.0 ** rng.integers(-5, 2, m)
        roots, far = whitening.secular_roots(d, z)
        assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()
        f = 1 + (z * z / far).sum(axis=1)
        assert np.median(np.abs(f) / (1 + (z * z / np.abs(far)).sum(axis=1))) < 1e-12


def check_whitened(got, rows, components=32):
    """got against the covariance of rows(vec_id, vector) taken whole."""
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for (i, _), row in zip(rows, x)}
    w = {(r.vec_id, r.component): r.whitened for r in got}
    for r in got:
        assert r.deviation == exact[r.vec_id] and r.identity_error < 1e-8
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
    for c in range(k):
        want, have = y @ q[:, c] / np.sqrt(e[c]), np.array([w[i, c + 1] for i, _ in rows])
        have *= np.sign(want @ have)
        assert np.abs(want - have).max() < 1e-6


def test_whitening_equals_the_whole_decomposition(spark):
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(900, 12)) * np.linspace(1, 5, 12)) @ rng.normal(size=(12, 12))
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(np.vstack([v, np.repeat(v[:1], 400, axis=0)]))]
    bad = [(5000, None), (5001, [1.0] * 11 + [None]), (5002, [float("nan")] * 12), (5003, [float("inf")] * 12), (5004, [1.0] * 11), (5005, []), (5006, [1e300] * 12)]
    df = spark.createDataFrame([(*r, "l", "n") for r in rows + bad], "vec_id long, embedding array<double>, label string, n string").repartition(40)
    check_whitened(whitening.whiten(df).collect(), rows)
    assert [r.component for r in whitening.whiten(df, 2).filter("vec_id = 3").orderBy("component").collect()] == [1, 2]


@pytest.mark.parametrize("fold", [0, 2])
def test_spectrum_before_the_last_step(fold, monkeypatch):
    """What the updates alone find, folded or vector by vector, is the decomposition already."""
    monkeypatch.setattr(whitening, "FOLD", fold)
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(700, 20)) * np.linspace(1, 9, 20)
    values, basis = np.zeros(20), np.eye(20)
    for block in whitening.folded(rows):
        values, basis = whitening.take_all(values, basis, block)
    assert np.allclose(scatter(values, basis), rows.T @ rows, atol=1e-7) and np.allclose(values, np.linalg.eigvalsh(rows.T @ rows), rtol=1e-9)


def test_whitening_of_flat_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]  # one direction of three
    check_whitened(whitening.whiten(spark.createDataFrame(rows, schema)).collect(), rows)
    wide = [(i, [float(2**30 * (i % 3)), float(i)]) for i in range(500)]
    got = whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).filter("component = 1").collect()
    assert {r.deviation is None for r in got} == {True}


def test_whitening_of_the_given_table(spark):
    got = queries.op12_whitening(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitened(got, [(r.vec_id, r.embedding) for r in rows])
