"""Operators 6, 9 and 10 against brute force, with awkward rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tidewell.llm import rlz_dedup, simhash, suffix_dedup
from tidewell.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, th string, key int"  # the last two clash with internal names


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["wört", "aa", "b", "the", "longerword", "xyz", "q1", "　", "mid"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, other = text(60), text(90)
    rows = [None, "", " \t\n", "a" * 700, "ab " * 400, passage, passage, f"{text(80)} {passage} {text(70)}", f"{text(20)}\n{passage}{text(20)}", f"{passage} {passage}"]
    rows += [f"{text(rng.randint(0, 60))} {other[i:]} {text(rng.randint(0, 60))}" for i in range(0, 200, 9)]
    rows += [f"{passage} {text(3)} {i}" for i in range(40)] + [text(rng.randint(1, 120)) for _ in range(30)] + [text(1500)]
    out = [(i, t, "en", "x", i) for i, t in enumerate(rows)]
    return out + [out[7], (None, passage, None, None, None)]


def covered(units: list, length: int) -> list[list[bool]]:
    """Positions covered by a window that starts more than once in the corpus."""
    count: dict = {}
    windows = [[u[i : i + length] for i in range(len(u) - length + 1)] for u in units]
    for w in windows:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = []
    for u, w in zip(units, windows):
        hit = [False] * len(u)
        for i, x in enumerate(w):
            if count[x] > 1:
                hit[i : i + length] = [True] * length
        out.append(hit)
    return out


@pytest.mark.parametrize("hot, batch_bytes", [(256, 1 << 30), (3, 9_000), (256, 4_000)])
def test_bytes(spark, hot, batch_bytes):
    rows = corpus(1)
    got = suffix_dedup.remove_long_matches(spark.createDataFrame(rows, SCHEMA), hot_classes=hot, batch_bytes=batch_bytes).collect()
    units = [(r[1] or "").encode() for r in rows]
    want = []
    for r, u, hit in zip(rows, units, covered(units, 200)):
        runs = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        want.append((r[0], len(u), sum(hit), runs, hashlib.sha256(bytes(b for b, h in zip(u, hit) if not h)).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(g)[:5]) for g in got)
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("hot", [256, 3])
def test_words(spark, hot):
    rows = corpus(2) + [(900 + i, t, "en", "x", 1) for i, t in enumerate(alike())]
    got = rlz_dedup.remove_factors(spark.createDataFrame(rows, SCHEMA), hot_classes=hot).collect()
    units = [tuple((r[1] or "").encode().split()) for r in rows]
    want = [(r[0], len(u), sum(hit), hashlib.sha256(b" ".join(w for w, h in zip(u, hit) if not h)).hexdigest()) for r, u, hit in zip(rows, units, covered(units, 35))]
    assert sorted(map(str, want)) == sorted(str(tuple(g)[:4]) for g in got)
    assert sum(w[2] for w in want) > 1000
    assert all(g.n_removed == 0 for g in got if g.doc_id is not None and g.doc_id >= 900)


def alike() -> list[str]:
    """Texts of 34 common words and one word each on which polynomial hashes modulo 2^64 agree for every base."""
    one, other = "a", "b"
    for _ in range(12):
        one, other = one + other, other + one
    shared = " ".join(f"w{i}" for i in range(34))
    return [f"{shared} {one}", f"{shared} {other}"] * 1 + [f"{one} {shared}", f"{other} {shared}"]


def test_levels_are_sorted_suffixes_and_merge_geometrically(spark):
    rows = corpus(5)
    search = suffix_dedup.Repeats(spark, 200, 40, suffix_dedup.ByteUnits)
    texts = search.texts(spark.createDataFrame(rows, SCHEMA), 200)
    found, _ = search.anchor_table(texts, heads=True)
    family, sizes = suffix_dedup.LevelFamily(search), []
    for b in range(7):
        family.add(found.filter(f"pmod(xxhash64(th), 7) = {b}"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    by_th = {r.th: (r.text or "").encode() for r in texts.collect()}
    for _, table in family.levels:
        for r in spark.table(table).collect():
            assert by_th[r.th][r.pos : r.pos + 40] == r.head
    heads: dict = {}
    for r in found.collect():
        heads.setdefault(bytes(r.head), [r.key, 0])[1] += 1
    assert {r.key for r in family.repeated().collect()} == {k for k, n in heads.values() if n > 1}
    search.close()


def test_sorted_strings_and_common_prefixes():
    rng = random.Random(6)
    strings = [bytes(rng.choices([0, 1, 255], k=rng.randint(0, 7))) for _ in range(300)]
    group = np.sort(np.array([rng.randint(0, 9) for _ in strings]))
    rows = np.zeros((300, 7), np.uint8)
    for r, s in zip(rows, strings):
        r[: len(s)] = np.frombuffer(s, np.uint8)
    order, common = suffix_dedup.sorted_strings(group, rows, np.array([len(s) for s in strings]))
    ranked = [(int(group[i]), strings[i]) for i in order]
    assert ranked == sorted(ranked)
    for k in range(1, 300):
        (g, a), (h, b) = ranked[k - 1], ranked[k]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == (same if g == h else -1)


@pytest.mark.parametrize("seed", range(6))
def test_factors_are_greedy_and_maximal(seed):
    rng = random.Random(seed)
    passages = [rng.choices([b"x", b"yy", b"z", b"q"][: 2 + seed % 3], k=rng.randint(1, 40)) for _ in range(12)]
    passages += [passages[0][2:] + passages[1], passages[2] * 3, [b"alone"]]
    block = rlz_dedup.ReferenceBlock(passages)

    def elsewhere(p, i):
        best = 0
        for q, other in enumerate(passages):
            for j in range(len(other)):
                if (p, i) != (q, j):
                    n = 0
                    while i + n < len(passages[p]) and j + n < len(other) and passages[p][i + n] == other[j + n]:
                        n += 1
                    best = max(best, n)
        return best

    want, starts = [], set()
    for p, words in enumerate(passages):
        i = 0
        while i < len(words):
            n = elsewhere(p, i)
            want.append((int(block.start[p]) + i, n))
            i += max(n, 1)
        starts |= {int(block.start[p]) + i for i in range(len(words)) if elsewhere(p, i) >= 5}
    at, size = block.parse()
    assert list(zip(at.tolist(), size.tolist())) == want
    assert set(block.repeated(5).tolist()) == starts


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_long_matches(none).collect() == []
    assert rlz_dedup.remove_factors(none).collect() == []
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []


def plain_fingerprint(text) -> int:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rows = corpus(3)
    rng = random.Random(3)
    rows += [(100 + i, " ".join(w if rng.random() > 0.004 else "zz" for w in rows[-3][1].split()), "en", "x", 1) for i in range(40)]
    fps = {(r[0], r[1]): plain_fingerprint(r[1]) for r in rows}
    nodes = sorted(set(fps.values()))
    group = {f: f for f in nodes}

    def find(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 4 and find(a) != find(b):
                group[find(a)] = find(b)
    least: dict = {}
    for (d, _), f in fps.items():
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    df = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in got) == sorted((str(r[0]), fps[r[0], r[1]], least[find(fps[r[0], r[1]])]) for r in rows)
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values()) and kept[0].asDict().keys() == set(df.columns)
    assert len(least) < len(nodes)


def test_tree_join_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    one = lambda: np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    codes = np.unique(base[rng.integers(0, 20, 2000)] ^ one() ^ one())
    want = np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4, 1)
    got = {(min(i, j), max(i, j)) for a, b in simhash.tree_join(codes, 4) for i, j in zip(a.tolist(), b.tolist())}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(want))))


def test_hot_keys_are_dealt_over_cells(spark):
    rng = random.Random(9)
    base = rng.getrandbits(63)
    codes = sorted({base ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)})
    edges = simhash.links(spark.createDataFrame([(c,) for c in codes], "fp long"), cell=20)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    near = [c for c in codes if (c ^ base).bit_count() <= 2]
    assert {got[c] for c in near} == {min(near)} and set(got) == set(near)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (3, 2), (2, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unsettled_components_raise(spark):
    edges = spark.range(20).selectExpr("id AS a", "id + 1 AS b")
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=1)


def test_fingerprint_of_a_very_long_text():
    text = " ".join(f"w{i}" for i in range(40_000))
    assert simhash.fingerprint(np.frombuffer(text.encode(), np.uint8)) == plain_fingerprint(text)
