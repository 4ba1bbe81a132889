"""Operator 13: the prefix trie of conversations, its subtree totals rolled up in bands of depth.

A node is a distinct sequence of first turns. Its id is the exclusive-or of one 128-bit hash per turn, salted with the
turn's depth, so ids of all prefixes come from a running aggregate, also over parts of one endless conversation, and
the id of a parent from its child's.

The rollup: each node adds its own figures to its ancestors in its band of BAND depths only. The nodes on which bands
begin then form a trie of their own, BAND times lower, which is rolled up alike; completed totals of such band roots are
last added to the nodes of the band above. So a node is copied at most BAND times, and a trie of depth d takes
2 log(d) / log(BAND) rounds.

Cases: rows with a null conv_id belong to no conversation and are left out; null role or text is empty; turns go by
turn, null first, ties by the SHA-256 of role and text (equal rows are turns of their own); texts of any length and
conversations of any number of turns are taken whole; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE_CLASS, delete_path, in_order, look_up, materialize

#: Depths of a band; also the most ancestors that a node is copied to in one round.
BAND = 16
#: Turns of a conversation whose hashes are summed in one task.
CHUNK = 1024
#: Conversation ids that are joined into one string before hashing.
BLOCK = 4096

KEY = ["d", "xa", "xb"]


def words(text) -> "F.Column":
    return F.regexp_count(text, F.lit(f"[^{SPACE_CLASS[1:-1]}]+")).cast("long")


def number_turns(conversations: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, digest, words) with d the place of the turn, from 1, and (conv_id, n_turns)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    facts = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), words(text).alias("words"))
    facts = materialize(facts, "facts", paths)  # else the sampling for the order would read all texts as well
    rows = in_order(facts, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")], "turns", paths)
    pieces = rows.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("part", "conv_id", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    numbered = rows.join(pieces, ["part", "conv_id"]).select("conv_id", (F.col("at") + F.col("shift")).alias("d"), "digest", "words")
    return numbered, rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"))


def share_heads(turns: DataFrame, convs: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the head of another: the first h turns of conversation c - c % 20, then their own
    turns after their first h, h = crc32(decimal c) % 4."""
    convs = convs.select("*", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"), F.expr("conv_id - conv_id % 20").alias("base"))
    heads = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    taken = F.coalesce(F.least("h", "base_turns"), F.lit(0).cast("long"))
    depth = taken + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    convs = convs.join(heads, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), depth.alias("depth"), "n_turns")
    convs = materialize(convs, "heads", paths)
    # h depends on conv_id alone; where a base has fewer than h turns, later turns move up by what is missing
    short = convs.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("gap"), "n_turns")
    own = turns.filter(F.col("d") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    own = look_up(own, short, ["conv_id"], "n_turns", convs.agg(F.sum("n_turns")).first()[0] or 0)
    own = own.select("conv_id", (F.col("d") - F.coalesce("gap", F.lit(0))).alias("d"), "digest", "words")
    head = turns.filter("d <= 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "d", "digest", "words")
    head = convs.filter("taken > 0").join(head, "base").filter("d <= taken").select("conv_id", "d", "digest", "words")
    return own.unionByName(head), convs.select("conv_id", F.col("depth").alias("n_turns"))


def with_prefix_ids(turns: DataFrame) -> DataFrame:
    """(conv_id, d, xa, xb, ca, cb, words): x is the id of the first d turns, c the hash of turn d alone."""
    hashed = turns.select("conv_id", "d", F.xxhash64("d", "digest").alias("ca"), F.xxhash64("digest", F.lit(13), "d").alias("cb"), "words", F.expr(f"(d - 1) div {CHUNK}").alias("chunk"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("ca").alias("sa"), F.bit_xor("cb").alias("sb"))
    sums = sums.select("conv_id", "chunk", *(F.coalesce(F.bit_xor(s).over(earlier), F.lit(0).cast("long")).alias(s) for s in ("sa", "sb")))
    here = Window.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    ids = [F.bit_xor(c).over(here).bitwiseXOR(F.col(s)).alias(x) for c, s, x in (("ca", "sa", "xa"), ("cb", "sb", "xb"))]
    return hashed.join(sums, ["conv_id", "chunk"]).select("conv_id", "d", *ids, "ca", "cb", "words")


def with_ancestors(rows: DataFrame, step: int) -> DataFrame:
    """rows (depths divisible by step) with up: their ancestors at such depths, back to the last depth where a band
    of step * BAND begins; the nearest is the last."""
    w = Window.partitionBy("conv_id", F.expr(f"(d - 1) div {step * BAND}")).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    parent = F.struct((F.col("d") - step).alias("d"), F.col("xa").bitwiseXOR(F.col("ca")).alias("xa"), F.col("xb").bitwiseXOR(F.col("cb")).alias("xb"))
    return rows.withColumn("up", F.collect_list(parent).over(w))


def band_roots(rows: DataFrame, step: int) -> DataFrame:
    """The rows at depths divisible by step * BAND, c now the hash of all turns since the band root before."""
    w = Window.partitionBy("conv_id", F.expr(f"(d - 1) div {step * BAND}"))
    return rows.select("conv_id", *KEY, F.bit_xor("ca").over(w).alias("ca"), F.bit_xor("cb").over(w).alias("cb")).filter(F.col("d") % (step * BAND) == 0)


def add_up(own: DataFrame, below: DataFrame, sums: list[str]) -> DataFrame:
    """The sums of own(key, sums) and of what below(up, sums) adds to its ancestors, by node."""
    far = below.select(F.explode("up").alias("u"), *sums).select("u.*", *sums)
    return own.select(*KEY, *sums).unionByName(far).groupBy(*KEY).agg(*(F.sum(s).alias(s) for s in sums))


def roll_up(values: DataFrame, levels: list[DataFrame], sums: list[str], paths: list[str]) -> DataFrame:
    """Subtree totals of values(key, sums), the root included; levels[k] has the ancestors of nodes at depths
    divisible by BAND ** k."""
    within, now = [], values
    for k, level in enumerate(levels):
        inner = level.filter(F.col("d") % BAND ** (k + 1) != 0).join(now, KEY)
        within.append(materialize(add_up(now, inner, sums), f"band{k}", paths))
        now = within[-1].filter(F.col("d") % BAND ** (k + 1) == 0)
    total = within[-1]
    for k in range(len(levels) - 2, -1, -1):
        roots = levels[k].filter(F.col("d") % BAND ** (k + 1) == 0).join(total, KEY)
        total = materialize(add_up(within[k], roots, sums), f"total{k}", paths)
    return total


def hash_blocks(batches):
    """SHA-256 of the joined blocks of each node; blocks of a node follow each other, over batches too."""
    key, state, out = None, None, []

    def flush():
        rows = {c: [r[i] for r in out] for i, c in enumerate([*KEY, "ends_sha256"])}
        out.clear()
        return pa.RecordBatch.from_pydict(rows, pa.schema([(c, pa.int64()) for c in KEY] + [("ends_sha256", pa.string())]))

    for batch in batches:
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"])):
            if now == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            state.update(ids.encode())
        if len(out) > 10_000:
            yield flush()
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield flush()


def end_digests(ends: DataFrame, paths: list[str]) -> DataFrame:
    """ends(key, conv_id): per node the SHA-256 of its conv_ids, ascending, comma-joined. Ids are joined in blocks of
    at most BLOCK wherever they lie, so that one task sees a hot node as a few strings only."""
    rows = in_order(ends, [F.col(c) for c in [*KEY, "conv_id"]], "ends", paths)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = rows.groupBy(*KEY, "part", F.expr(f"at div {BLOCK}").alias("block")).agg(ids.alias("ids"))
    blocks = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "part", "block").select(*KEY, "ids")
    return blocks.mapInArrow(hash_blocks, "d long, xa long, xb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shared_heads: bool = False) -> DataFrame:
    """One row per node of the trie of conversations(conv_id, turn, role, text).

    conv_id: smallest member; depth; parent_conv_id (root: null); n_convs; n_children; n_leaves: childless nodes of the
    subtree; saved_tokens: words that the subtree would spare if each shared turn were read once; ends_sha256: digest of
    the members that end here; node: its id. With shared_heads, conversations are rebuilt by share_heads() first.
    """
    spark, paths = conversations.sparkSession, []
    turns, convs = number_turns(conversations, paths)
    if shared_heads:
        turns, convs = share_heads(turns, convs, paths)
    convs = materialize(convs, "convs", paths)
    rows = materialize(with_prefix_ids(turns), "prefixes", paths)
    n_convs, least, deepest = convs.agg(F.count("*"), F.min("conv_id"), F.max("n_turns")).first()

    levels, at, step = [], rows, 1
    while True:
        up = with_ancestors(at, step)
        figures = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words")] if step == 1 else []
        levels.append(materialize(up.groupBy(*KEY).agg(*figures, F.first("up").alias("up")), f"nodes{len(levels)}", paths))
        if (deepest or 0) < step * BAND:
            break
        at, step = materialize(band_roots(at, step), "roots", paths), step * BAND

    zero = F.lit(0).cast("long")
    one = spark.range(1 if n_convs else 0)
    top = one.select(*(zero.alias(c) for c in KEY), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(least).cast("long").alias("conv_id"), zero.alias("words"))
    nodes = levels[0].select(*KEY, "n_convs", "conv_id", "words", F.element_at("up", -1).alias("p"))
    children = nodes.groupBy(F.col("p.d").alias("d"), F.col("p.xa").alias("xa"), F.col("p.xb").alias("xb")).agg(F.count("*").alias("n_children"))
    nodes = nodes.unionByName(top.withColumn("p", F.lit(None).cast("struct<d:bigint,xa:bigint,xb:bigint>"))).join(children, KEY, "left")
    nodes = materialize(nodes.withColumn("n_children", F.coalesce("n_children", zero)), "nodes", paths)

    values = nodes.select(*KEY, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = roll_up(values, [x.select(*KEY, "up") for x in levels], ["n_leaves", "saved_tokens"], paths)
    last = rows.select("conv_id", *KEY).join(convs.withColumnRenamed("n_turns", "d"), ["conv_id", "d"])
    turnless = convs.filter("n_turns = 0").select("conv_id", *(zero.alias(c) for c in KEY))
    digests = end_digests(last.select("conv_id", *KEY).unionByName(turnless), paths)

    parents = nodes.select(*(F.col(c).alias(f"p{c}") for c in KEY), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("rows"))
    found = nodes.select(*KEY, "n_convs", "conv_id", "n_children", *(F.col(f"p.{c}").alias(f"p{c}") for c in KEY))
    found = look_up(found, parents, [f"p{c}" for c in KEY], "rows", max(1, nodes.count()))
    out = found.join(totals, KEY).join(digests, KEY, "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.concat(F.hex("xa"), F.lit("-"), F.hex("xb")).alias("node"),
    )
    out = materialize(out, "trie")
    for path in paths:
        delete_path(spark, path)
    return out


ORACLE = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce("text", '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce("text", ''))) AS j
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM (SELECT conv_id, conv_id::VARCHAR AS s, count(*) AS n FROM own GROUP BY 1, 2)),
taken AS (SELECT c.conv_id, c.base, c.h, coalesce(least(c.h, b.n), 0) AS k FROM conv c LEFT JOIN conv b ON b.conv_id = c.base),
rebuilt AS (
  SELECT t.conv_id, o.j - t.h + t.k AS d, o.role, o.txt FROM taken t JOIN own o ON o.conv_id = t.conv_id AND o.j > t.h
  UNION ALL SELECT t.conv_id, o.j, o.role, o.txt FROM taken t JOIN own o ON o.conv_id = t.base AND o.j <= t.k),
prefix AS (
  SELECT conv_id, d, txt, list({'r': role, 't': txt}) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path,
    d = count(*) OVER (PARTITION BY conv_id) AS ends FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', [], conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM conv),
node AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, len(regexp_extract_all(any_value(txt), '[^\x20\x09-\x0D]+')) AS w,
    coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends)), sha256('')) AS sha FROM prefix GROUP BY path, d),
pair AS (SELECT DISTINCT a.path AS u, b.path AS v FROM prefix a JOIN prefix b ON a.conv_id = b.conv_id AND a.d <= b.d),
kids AS (SELECT path[:d - 1] AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
total AS (
  SELECT u, sum((v.n - 1) * v.w) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM pair JOIN node v ON v.path = pair.v LEFT JOIN kids k ON k.path = pair.v GROUP BY u)
SELECT x.conv_id::BIGINT AS conv_id, x.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, x.n::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, x.sha AS ends_sha256
FROM node x JOIN total t ON t.u = x.path LEFT JOIN kids k ON k.path = x.path LEFT JOIN node p ON x.d > 0 AND p.d = x.d - 1 AND p.path = x.path[:x.d - 1]
"""
