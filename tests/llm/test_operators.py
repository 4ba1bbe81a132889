"""Operators 1 to 5, 7 and 8: invariants, brute force, round trips, held-out accuracy; awkward rows for each."""

import gzip
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, decontam, mixing, pii, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or ""), "x", "y") for i, t in enumerate(texts)], DOCS)


# ---- 1


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 40, 200]))), "en", rng.choice(["b", "a", "a", "a", "é", None, "Z", "tiny"]), 1, None, None) for i in range(4000)]
    df = spark.createDataFrame(rows + rows[:3] + [(None, None, None, None, None, None, None)], DOCS)
    got = mixing.mix(df, bucket=100).collect()
    assert len(got) == len(rows) + 4
    per: dict = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0
        per.setdefault(r.source, []).append(r)
    names = sorted([s for s in per if s is not None], key=lambda s: s.encode()) + [None]
    size = {s: sum(r["size"] for r in per[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in names:
        want = 2 * size[s] if s in full else level * weight[s]
        assert per[s][0].source_size == size[s] and per[s][0].target == pytest.approx(want)
        assert abs(sum(r.taken for r in per[s]) - want) <= 0.01 * size[s] + 200
    again = mixing.mix(df.repartition(3), bucket=100).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(df.limit(0)).collect() == []


def test_mix_lands_every_source_by_itself(spark):
    rng = random.Random(11)
    rows = [(f"small{k}", 150 if i == 0 else rng.randint(1, 12)) for k in range(8) for i in range(90)]
    rows += [("some", 150 if i < 3 else rng.randint(1, 12)) for i in range(250)] + [("big", rng.randint(1, 12)) for _ in range(900)]
    sizes = {s: sum(n for t, n in rows if t == s) for s, _ in rows}
    df = spark.createDataFrame([(i, s, n, 0.45, rng.getrandbits(62)) for i, (s, n) in enumerate(rows)], "doc_id long, source string, size long, x double, salt long")
    got = mixing.cube(df, bucket=100).collect()
    assert len(got) == len(rows) and {r.x for r in got} == {0.0, 1.0}
    off = {s: abs(sum(r.x * r["size"] for r in got if r.source == s) - 0.45 * sizes[s]) for s in sizes}
    assert max(off.values()) <= 1.0, off


def test_mix_keeps_long_ids_and_deals_repeated_rows(spark):
    ids = [2**53 + 1, 2**53 + 3, 2**62 + 5, -(2**60) - 1, None]
    df = spark.createDataFrame([(i, "w " * k, "en", "s", 0, None, None) for k, i in enumerate(ids)] + [(77, "x y z", "en", "s", 0, None, None)] * 500, DOCS)
    got = mixing.mix(df, bucket=50).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in df.select("doc_id").collect())
    assert abs(sum(r.taken for r in got) - got[0].target) <= 3


def test_flight_keeps_balance():
    import numpy as np

    rng = np.random.default_rng(2)
    size = rng.integers(0, 1000, 500).astype(float)
    x = mixing.flight(np.full(500, 0.37), size, 5)
    assert ((x > 0) & (x < 1)).sum() <= 2
    assert x.sum() == pytest.approx(0.37 * 500) and (x * size).sum() == pytest.approx(0.37 * size.sum())


# ---- 2


def test_decontamination(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:15])), (2, " ".join(words[8:30])), (3, "Short ITEM here"), (4, None), (5, "!!"), (6, "w1 w2 w3"), (7, " ".join(words[:15])), (None, "null id")]
    texts = [" ".join(words), " ".join(words[:9]), "a short-item, HERE it is", None, "", "w1 w2 w2 w3 w1 w2 w3 w4", " ".join(words[3:14]).upper() + " x", "é ß short item", "the null id!", " ".join(words * 300)]
    item_rows = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, texts)

    def split(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    want = []
    for i, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for name, text in items:
            v = split(text)
            for s in range(max(1, len(v) - 9) if v else 0):
                g = v[s : s + 10]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        found.add("" if name is None else str(name))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, decontam.report(df, item_rows).collect())) == want
    blocks = decontam.overlaps(df, item_rows, block_words=10).select("doc.doc_id", "n_words", "items").collect()
    assert {(r.doc_id, r.n_words, len(r["items"])) for r in blocks} == {(a, b, d) for a, b, _, d, _, _ in want}
    clean = {r.doc_id: r.text for r in decontam.decontaminate(df, item_rows).collect()}
    assert clean[2] == "a  it is" and 0 not in clean and clean[3] is None and clean[1] == texts[1].replace("w1 w2 w3", "") and clean[7] == texts[7]
    assert decontam.report(df, item_rows.limit(0)).filter("contaminated").count() == 0
    assert decontam.report(df.limit(0), item_rows).count() == 0


def test_automaton_is_small():
    words = [f"w{(i * 7919) % 5003}" for i in range(60_000)]
    auto = decontam.ItemAutomaton([("1", [w.encode() for w in words]), ("2", [b"w1", b"w2"])], 10)
    assert sum(len(x) * x.itemsize for x in (auto.symbol, auto.target, auto.link, auto.length, auto.items, auto.up)) < 60 * len(words)
    n, hit, found = auto.match(" ".join(words[100:150]).encode())
    assert n == 50 and hit.all() and found == {"1"}


def test_automaton_of_items_that_share_a_header():
    head, rng = [f"h{i}".encode() for i in range(12)], random.Random(1)
    auto = decontam.ItemAutomaton([(str(i), head + [f"w{rng.randrange(50_000)}".encode() for _ in range(20)]) for i in range(8000)], 10)
    assert len(auto.members) == 8000 * 23 and auto.members.nbytes + auto.first.nbytes < 3_000_000
    assert auto.match(b" ".join(head))[2] == {str(i) for i in range(8000)}


CLASH = ["n_words", "hits", "items", "doc", "base", "added", "all", "candidates", "fresh", "score", "_text", "th", "size", "salt", "n"]


def test_columns_of_any_name_pass(spark):
    texts = ["mail joe@x.io or w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 end of it and more words than that", None, "", "plain words"]
    df = docs(spark, texts).drop("score", "size").withColumns({c: F.lit(f"own {c}") for c in CLASH})
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12))), (2, "other words of an item which is long enough to be two blocks")], "item_id long, text string")
    assert decontam.overlaps(df, items, block_words=5).count() == 4
    model = toxicity.Model(toxicity.np.zeros(toxicity.CLASSES**4, toxicity.np.float32), -1.0, 1.0, 0.0)
    for out in (decontam.decontaminate(df, items), pii.redact(df), toxicity.drop_toxic(df, model)):
        assert out.columns == df.columns
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == 4 and all(r[c] == f"own {c}" for r in rows.values() for c in CLASH) and rows[1].text is None
    assert "joe@x.io" not in {r.doc_id: r for r in pii.redact(df).collect()}[0].text


# ---- 3


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    syllables = ["on", "the", "re", "an", "ti", "so", "mel", "ka", "dur", "lo", "fin"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    insults = ["grubbex", "vilkhopp", "zanthwik"]
    rows, labels = [], []
    for i in range(1500):
        text = [word() for _ in range(rng.randint(3, 80))]
        bad = i % 4 == 0
        for _ in range(2 if bad else 0):
            w = rng.choice(insults)
            text.insert(rng.randint(0, len(text)), w if rng.random() < 0.7 else w[:4] + rng.choice(".*-") + w[4:])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, "word " * 30_000), (5003, "x"), (None, "the"), rows[0], (5004, "you g.r.u.b.b.e.x fool")]
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + labels[:5] + [(None, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.report(df, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].score == by_id[5001].score < 0.5 and by_id[5004].score > by_id[5003].score
    assert toxicity.report(df, known.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.report(df.limit(0), known).count() == 0
    few = toxicity.report(df.filter("doc_id < 100 OR doc_id >= 5000"), known.filter("doc_id IN (1, 2, 3, 6, 7, 9)").withColumn("toxic", (F.col("doc_id") == 1).cast("int"))).collect()
    assert all(0 <= r.score <= 1 for r in few) and len({r.score for r in few}) > 1


def plain_kernel(a: str, b: str) -> float:
    """The kernel by its definition: all common subsequences of four letters with at most one character between two."""

    def features(s):
        c, out = toxicity.codes(s[: toxicity.WINDOW]).tolist(), {}
        for i in range(len(c)):
            for offsets in toxicity.GAPS:
                at = [i, *(i + o for o in offsets)]
                if at[-1] < len(c) and all(c[x] for x in at):
                    key = tuple(c[x] for x in at)
                    out.setdefault(key, []).append(toxicity.DECAY ** (at[-1] - i + 1))
        return {k: sum(v) for k, v in out.items()}, (toxicity.SMOOTH + sum(x * x for v in out.values() for x in v)) ** 0.5

    (x, m), (y, n) = features(a), features(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / m / n


def test_kernel_is_the_subsequence_kernel_in_all_scripts():
    strings = [" stupid", "s t u p i d", "st.up.id x", "глупый человек", "г.л.у.п.ы.й", "aaaaaa aaaaa", "şğıöü kötü söz", "sgiou kotu soz", "愚かな人間だよね", "", "ab"]
    landmarks = [s for s in strings if len(s) > 3]
    got = toxicity.Nystroem(landmarks).kernel(strings)
    for i, s in enumerate(strings):
        for j, t in enumerate(landmarks):
            assert got[i, j] == pytest.approx(plain_kernel(s, t), abs=1e-5)
    assert plain_kernel("şğıöü kötü söz", "sgiou kotu soz") == pytest.approx(plain_kernel("sgiou kotu soz", "sgiou kotu soz"))
    assert plain_kernel("глупый человек", "г.л.у.п.ы.й") > 0.1


def test_worst_passage_equals_the_folded_decision():
    import numpy as np

    rng = np.random.default_rng(5)
    space = toxicity.Nystroem([" stupid", "moron an", "the word "])
    w = rng.normal(size=3)
    text = "an ordinary text with a st.upid word and a mo-ron in it"
    f, at = toxicity.worst([text], space.table(w), 0.5)
    padded = f" {text} "
    passages = [padded[i : i + toxicity.WINDOW] for i in range(len(padded))]
    assert f[0][0] == pytest.approx((space.map(passages) @ w).max() + 0.5, abs=1e-4)


def test_memory_of_the_fit():
    """No second matrix of the size of the passages' map, which lies in the driver."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 14)) for _ in range(12_000)]
    space, peak = toxicity.Nystroem(words[:200]), {}

    def used(name, f):
        tracemalloc.start()
        out = f()
        peak[name] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    x = used("map", lambda: space.map(words))
    y = np.where(rng.random(len(x)) < 0.3, 1.0, -1.0)
    w, _ = used("svm", lambda: toxicity.svm(x, y, np.ones(len(x))))
    used("table", lambda: space.table(w))
    assert peak["map"] < 1.6 * x.nbytes and peak["svm"] < 1.5 * x.nbytes and peak["table"] < 1.2 * space.phi.nbytes + 4 * toxicity.CLASSES**4, (peak, x.nbytes, space.phi.nbytes)


def test_joined_decisions_and_readings():
    import numpy as np

    assert toxicity.joined([0.5] * 4) == pytest.approx(0.5) and toxicity.joined([]) == -1 == toxicity.joined([-3.0, -7.0])
    assert toxicity.joined([2.0, -5.0]) == pytest.approx((27 / 4) ** (1 / 3) - 1)  # one plain passage is enough
    space = toxicity.Nystroem([" stupid", "the word ", "réeux mot"], marks=True)
    table = space.table(np.array([1.0, -1.0, 1.0]))
    (plain, marked, own, other, none), _ = toxicity.worse_reading(["a stupid man", "a stüpïd man", "un réeux ici", "un reeux ici", None], table, 0.0, 1)
    assert marked[0] == pytest.approx(plain[0], abs=1e-6) and own[0] > other[0] and len(none) <= 1
    assert toxicity.worst(["a stüpïd man"], table, 0.0, marks=True)[0][0][0] < plain[0]


# ---- 4

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text: str) -> list[str]:
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark):
    rng = random.Random(4)
    odd = [None, "", "a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.255 0000000255.1.1.1", "+1 (314) 555-6532 4111 1111-1111 1111 +12-", "é" * 50 + " joe@x.io 4111111111111111 41111111111111112", "\U0001f600 a@b.co", "9" * 3000 + " a@b.cd", "+" * 30 + "123456789"]
    alphabet = "ab.@1 23-+()4é_%\n"
    odd += ["".join(rng.choices(alphabet, k=rng.randint(1, 120))) for _ in range(150)] + ["x" * 20_000 + "@" + "y." * 2000 + "z", "tel 12345 " * 500]
    df = docs(spark, odd)
    got = {r.doc_id: r for r in pii.report(df.unionByName(df.limit(1))).collect()}
    for i, t in enumerate(odd):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert got[i].spans.split(",")[: len(want)] == (want or [])[: len(want)]
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] is None and clean[1] == "" and clean[6] == "\U0001f600 [EMAIL]" and "joe@x.io" not in clean[5]
    assert pii.report(df.limit(0)).count() == 0
    plan = pii.redact(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_in_other_writings(spark):
    rng = random.Random(14)
    name = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    texts = []
    for i in range(800):
        texts.append(rng.choice([
            f"write to {name()}.{name()}@{name()}.com soon", f"mail {name()}@{name()}.co.uk", f"call me: +{rng.randint(30, 60)} {digits(3)} {digits(rng.randint(5, 8))}", f"{name()} +49 ({digits(2)}) {digits(4)}-{digits(4)}",
            "the token " + "".join(rng.choices("abXY12_-", k=rng.choice([24, 40, 90]))) + "z", f"order {digits(rng.randint(7, 14))} of {name()}", f"{name()} {digits(9)} {name()}", f"{name()} 3 @ {digits(1)} {name()}", f"{name()}-{name()}-{name()}-{digits(12)}",
        ]))
    planted = ["tel 030 123 4567890", "please phone 0211 4567 1234 today", "mine is joe.doe [at] site [dot] com ok", "ask jane(at)place(dot)org now", "jim @ place.org wrote", "token " + "aB3_" * 80 + " end"]
    plain = [f"order {digits(10)} of {name()}" for _ in range(30)] + [f"{name()} 3 @ 4 {name()}" for _ in range(10)]
    got = {r.doc_id: r.spans for r in pii.report(docs(spark, texts + planted + plain)).collect()}
    n = len(texts)
    assert all(got[n + i] for i in range(len(planted))), [got[n + i] for i in range(len(planted))]
    assert got[n + len(planted) - 1] == "key:6:326"
    assert sum(bool(got[n + len(planted) + i]) for i in range(len(plain))) <= 2


def test_pii_learns_from_all_documents(spark):
    """What no more than every other document is needed to know stands where a sample of half the documents, by the hash of their texts, has nothing."""
    keys = spark.range(4000).selectExpr("concat(IF(id % 2 = 0, 'the token ', 'made of '), repeat(concat('aB', id, '_'), 4 + CAST(id % 7 AS int)), 'z end') text")
    keys = keys.filter("pmod(xxhash64(text), 1000000) >= 500000")
    df = keys.unionByName(spark.range(100_000).selectExpr("concat('word ', id) text")).selectExpr("monotonically_increasing_id() doc_id", "text")
    n = keys.count()
    assert 1500 < n < 2500
    model = pii.train(df)
    assert model and set(model) == {"key"}
    got = pii.report(df).filter("spans <> ''").join(df, "doc_id").select("text", "spans").collect()
    assert len(got) == keys.filter("text LIKE 'the token %'").count() and all(r.text.startswith("the token ") and r.spans == f"key:10:{len(r.text) - 4}" for r in got)


def cut_spans(text, spans):
    """The text with the spans kind:start:end replaced, overlapping ones as one, named after the first."""
    out, at = [], 0
    for lo, hi, kind in sorted((int(a), int(b), k.upper()) for k, a, b in (x.split(":") for x in spans.split(",") if x)):
        if hi > at:
            out.append("" if lo < at else text[at:lo] + f"[{kind}]")
            at = hi
    return "".join(out) + text[at:]


def test_pii_of_long_lists(spark):
    rng = random.Random(6)
    texts = [" ".join(f"né{i}@mail{i % 97}.org 55{i:05d}12\U0001f600 (0{i}) 1.2.3.{i % 400}" for i in range(12_000))]
    texts += [" ".join(rng.choice(["a.b@c.de", "4111 1111 1111 1111", "+49 30 1234567", "tel 0301234567", "é", "10.0.0.1", "x [at] y [dot] z", "token abcdefghijklmnopqrstuvwxyz12"]) for _ in range(rng.choice([3, 70, 200]))) for _ in range(40)]
    df = docs(spark, texts)
    model = {kind: ([(1.0, 1.0)], 0.5) for kind in pii.GENERATORS}  # takes every candidate
    rows = pii.spans(df.select("doc_id", "text"), model).select("doc_id", pii.listed("base").alias("base"), pii.listed("base", "added").alias("spans"), F.array_sort(F.expr("transform(added, x -> struct(x.start, x.end))")).alias("added")).collect()
    clean = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    for r in rows:
        assert r.base == ",".join(base_spans(texts[r.doc_id]))
        assert clean[r.doc_id] == cut_spans(texts[r.doc_id], r.spans)
        base = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in r.base.split(",") if x))
        import bisect

        for a, b in r.added[:500]:
            k = bisect.bisect_left(base, (b, -1))
            assert not any(x < b and a < y for x, y in base[max(0, k - 8) : k + 1])
    assert "@" not in clean[0] and any(r.added for r in rows)


# ---- 5


def test_chat(spark):
    rows = [(1, 0, "user", "</s>[INST] \\e \\\\l < é"), (1, 1, "assistant", "[/INST]\\b"), (2, 5, "assistant", ""), (2, 3, None, None), (3, None, "assistant", "x"), (None, 0, "user", "y"), (4, 0, "assistant", "a" * 50_000), (4, 1, "user", "b"), (4, 1, "user", "b")]
    rows += [(5, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = db.execute(chat.ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in chat.report(df).collect())
    assert chat.report(df.limit(0)).count() == 1


def test_chat_of_texts_beyond_any_record_limit(spark):
    rows = spark.range(1).selectExpr("id AS conv_id", "0L AS turn", "'assistant' AS role", "repeat('ab<', 7000000) AS text")
    got = {r.conv_id: r for r in chat.report(rows.unionByName(spark.range(1).selectExpr("-1L AS conv_id", "0L AS turn", "'user' AS role", "'own' AS text"))).collect()}
    assert got[0].loss_chars == 21_000_000 and got[0].formatted_chars == 21_000_000 + 7_000_000 + len("[INST]assistant[/INST]</s>")
    assert sorted(r.n_turns for r in chat.report(rows.selectExpr("-1L AS conv_id", "turn", "role", "'x' AS text")).collect()) == [1, 2]


def test_layouts(spark):
    records = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a<b"}]}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"instruction": "i", "input": "", "output": "o"}', '{"instruction": "i", "output": "o"}', '{"prompt": "p", "completion": null}', '{"other": {"deep": [1, 2]}}', "not json", None,
        '{"id": 7, "messages": [{"role": "user", "name": "x", "content": "q"}], "meta": {"a": [1]}}', '{"messages": []}', '{"messages": "text"}', '{"id": "a", "prompt": "p", "completion": "c"}', '{"messages": [{"role": "user"}]}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "record_id int, record string")
    got = {r.record_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_records(df)).collect()}
    assert got == {
        0: [("user", "q"), ("assistant", "a<b")], 1: [("user", "q"), ("assistant", "a")], 2: [("system", "i"), ("assistant", "o")], 3: [("user", "i"), ("assistant", "o")], 4: [("user", "p"), ("assistant", "")],
        8: [("user", "q")], 9: [], 11: [("user", "p"), ("assistant", "c")],
    }
    unknown = {r.layout: r.n for r in chat.unmapped(df).collect()}
    assert unknown.pop(None) == 2 and sum(unknown.values()) == 3 and len(unknown) == 3


# ---- 7


def test_warc(spark):
    long = "<p>é" + "x" * 200
    rows = [(3, "http://a/\n1", long), (1, None, long), (2, "u", long + "\r\n\r\n"), (4, "v", "short"), (5, "v", "short"), (6, None, None), (None, "w", long), (1, None, long)] + [(100 + i, f"http://h/{i}", f"{i} " * 3000) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    index = warc.write_archives(warc.records(df), file_bytes=5_000)
    got = sorted(map(str, (tuple(r) for r in warc.read_records(index, range_bytes=3_000, gap=100).collect())))
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    want = []
    for p, _, h in rows:
        same = h == long
        want.append((p, len((h or "").encode()), sha(h), "revisit" if same and p != 1 else "response", 1 if same and p != 1 else None))
    assert got == sorted(map(str, want))
    assert index.select("path").distinct().count() > 3
    for path, rows in index.toPandas().groupby("path"):  # whole archives are valid gzip files, members in order of the index
        with gzip.open(path.removeprefix("file:"), "rb") as f:
            raw = f.read()
            assert raw.count(b"WARC/1.1\r\n") == len(rows) and raw.count(b"WARC-Profile: http") == raw.count(b"WARC-Type: revisit")
    some = warc.read_records(index.filter("page_id >= 150")).collect()
    assert sorted(r.page_id for r in some) == list(range(150, 160))
    assert warc.report(df.limit(0)).count() == 0


# ---- 8


def test_quality(spark):
    rng = random.Random(8)
    words = ["the", "of", "alpha", "beta", "|", "#x", "gamma", "é"]
    texts = [None, "", "one two", "a b c a b c", "a\nb\na\n \n \na", "the " * 5000, " ".join(words * 12)] + [rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(60)]
    texts += ["  x　y \x0b z\x0c"]
    df = docs(spark, texts)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = db.execute(quality.ORACLE)
    names = [d[0] for d in want.description]
    got = quality.report(df.unionByName(df.limit(0))).collect()
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got)
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality.report(df.limit(0)).count() == 0
