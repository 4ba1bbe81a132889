"""Operator 5: chat formatting by schema fingerprints, with built-in functions only.

The nested field paths of a record that the known mappings use, whatever its values, hash to fingerprints that select a
declarative mapping from its layout to canonical turns (role, text); further fields do not matter. Turns are then written in one template; control strings inside texts are
escaped reversibly, and a mask tells how many characters of each turn are trained on.

Template: [INST]role[/INST]text</s> per turn. In roles and texts a backslash becomes \\e, < becomes \\l, [ becomes \\b,
so no control string can appear there; undoing \\l, \\b and then \\e restores every text.

Cases: null text or role is empty; a null conv_id is a conversation; turns order by (turn, role, text), null first;
repeated rows are turns each; empty arrays of messages give no turns but a record; records of unknown layout give none
and are counted by unmapped(); a conversation -1 of the data is apart from the probe of that id; no rows: none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
TURNS_PER_PIECE = 256


@dataclass(frozen=True)
class Mapping:
    """The nested field paths of a layout and how they yield turns.

    each: path of an array of messages, or None; role and text: paths inside a message, or of the record;
    fixed: instead of one role and text, (role, path) pairs in order; blank texts of fixed pairs are left out.
    """

    each: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping(role="$.role", text="$.text"),
    Mapping(each="$.messages", role="$.role", text="$.content"),
    Mapping(each="$.conversations", role="$.from", text="$.value"),
    Mapping(fixed=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping(fixed=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping(fixed=(("user", "$.prompt"), ("assistant", "$.completion"))),
)

#: Role names of other layouts and their canonical form.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_of(record: Column) -> Column:
    """Nested field paths of a variant, in the order of their names, without types."""
    return F.regexp_replace(F.schema_of_variant(record), ": (?!OBJECT|ARRAY)[A-Z_]+(\\([0-9, ]+\\))?", "")


def needed(m: Mapping) -> list[str]:
    """Nested field paths that a mapping needs; others may be there or not."""
    if m.each:
        return sorted([m.each, *(m.each + "[0]" + p[1:] for p in (m.role, m.text))])
    return sorted([p for _, p in m.fixed] if m.fixed else [m.role, m.text])


def fingerprint(paths: list[str], there) -> Column:
    """Hash of those of the nested field paths that are there."""
    return F.xxhash64(F.array_join(F.array(*[F.when(there(p), p) for p in paths]), "\n"))


def wanted(m: Mapping) -> Column:
    return F.xxhash64(F.lit("\n".join(needed(m))))


def fits(record: Column, m: Mapping) -> Column:
    """Whether the record's fingerprint over the paths that m needs is that of m; an array of messages may be empty."""
    there = lambda p: F.try_variant_get(record, p, "variant").isNotNull()
    out = fingerprint(needed(m), there) == wanted(m)
    return out | (F.schema_of_variant(F.try_variant_get(record, m.each, "variant")) == "ARRAY<VOID>") if m.each else out


def turn(role: Column, text: Column, canonical_roles: bool = True) -> Column:
    name = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.struct((F.coalesce(name[role], role) if canonical_roles else role).alias("role"), text.alias("text"))


def turns(record: Column, mappings=MAPPINGS) -> Column:
    """array<struct<role, text>> of a variant record by the first mapping whose fingerprint it has; else null."""

    def get(v: Column, path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))

    def message(m: Mapping):
        return lambda v: turn(get(v, m.role), get(v, m.text))

    out = None
    for m in mappings:
        if m.fixed:
            rows = F.filter(F.array(*[turn(F.lit(r), get(record, p)) for r, p in m.fixed]), lambda t: (t["role"] == "assistant") | (F.trim(t["text"]) != ""))
        elif m.each:
            rows = F.transform(F.try_variant_get(record, m.each, "array<variant>"), message(m))
        else:
            rows = F.array(turn(get(record, m.role), get(record, m.text)))
        out = F.when(fits(record, m), rows) if out is None else out.when(fits(record, m), rows)
    return out


def turns_of_columns(table: DataFrame, mappings=MAPPINGS) -> Column:
    """The same of a table whose columns are the record's fields, by the schema alone: no record is built, so a text may
    be of any length. Names of roles stay as they are."""
    paths = {f"$.{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns}
    out = F.lit(None)
    for m in reversed(mappings):
        if not m.each and set(needed(m)) <= set(paths):
            pairs = [(F.lit(r), paths[p]) for r, p in m.fixed] or [(paths[m.role], paths[m.text])]
            there = fingerprint(needed(m), lambda p: F.lit(p in paths))
            out = F.when(there == wanted(m), F.array(*[turn(r, t, False) for r, t in pairs])).otherwise(out)
    return out


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def piece(t: Column) -> Column:
    """One turn in the template with its mask: characters to skip, to train on, and after them."""
    text = escape(t["text"])
    head = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE))
    loss = t["role"] == "assistant"
    return F.struct(
        F.concat(head, text, F.lit(END)).alias("out"),
        F.struct(F.length(head).alias("skip"), F.when(loss, F.length(text)).otherwise(0).alias("loss"), (F.when(loss, 0).otherwise(F.length(text)) + len(END)).alias("tail")).alias("mask"),
    )


def format_rows(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), one per turn, as (conv_id, formatted, mask).

    A conversation is put together from pieces of TURNS_PER_PIECE turn numbers, so no task sorts a long one whole.
    """
    record = turns_of_columns(rows.select("turn", "role", "text"))
    each = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.inline(record))
    part = F.floor(F.col("turn") / TURNS_PER_PIECE)
    pieces = each.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    pieces = pieces.select("conv_id", "part", F.transform("t", piece).alias("p"))
    pieces = pieces.select("conv_id", "part", F.array_join(F.col("p.out"), "").alias("out"), F.col("p.mask").alias("mask"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "out", "mask"))).alias("w"))
    return whole.select("conv_id", F.array_join(F.col("w.out"), "").alias("formatted"), F.flatten(F.col("w.mask")).alias("mask"))


def format_records(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """records(record_id, record: JSON string) of any known layout as (record_id, formatted, mask)."""
    v = records.select("record_id", turns(F.try_parse_json("record"), mappings).alias("t")).filter("t IS NOT NULL")
    v = v.select("record_id", F.transform("t", piece).alias("p"))
    return v.select("record_id", F.array_join(F.col("p.out"), "").alias("formatted"), F.col("p.mask").alias("mask"))


def unmapped(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """(layout, n) of the records that no mapping knows; unparsable ones have a null layout."""
    v = records.select(F.try_parse_json("record").alias("v"))
    v = v.select(layout_of(F.col("v")).alias("layout"), turns(F.col("v"), mappings).alias("t")).filter("t IS NULL")
    return v.groupBy("layout").agg(F.count("*").alias("n"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (role, text) and loss_texts, both from the formatted string and its mask alone."""
    parts = F.split("formatted", END)
    parts = formatted.withColumn("parts", F.slice(parts, 1, F.size(parts) - 1))
    halves = lambda p: F.split(p, "\\[/INST\\]")
    turn = lambda p: F.struct(unescape(F.substr(halves(p)[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(halves(p)[1]).alias("text"))
    # a mask entry of an assistant turn has nothing to train on only if the text is empty
    trained = F.zip_with("parts", "mask", lambda p, m: unescape(F.substr(p, m["skip"] + 1, m["loss"])))
    return parts.withColumns({"turns": F.transform("parts", turn), "loss_texts": trained}).drop("parts")


def report(conversations: DataFrame) -> DataFrame:
    """Digests of what read_back() finds, for all conversations and conversation -1, which holds control strings."""
    spark = conversations.sparkSession
    tricky = f"{END}{OPEN} ok {CLOSE}"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.lit(False).alias("probe"))
    rows = rows.unionByName(probe.withColumn("probe", F.lit(True)))
    # the data may have a conversation -1 of its own
    back = read_back(format_rows(rows.select(F.struct("conv_id", "probe").alias("conv_id"), "turn", "role", "text")))
    return back.select(
        "conv_id.conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(F.array_join("loss_texts", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("loss_texts", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"length({0}) + length({0}) - length(translate({0}, '\<[', ''))"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS probe FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{OPEN} ok {CLOSE}', true UNION ALL SELECT -1, 1, 'assistant', '{END}{OPEN} ok {CLOSE}', true)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(CLOSE) + len(END)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id, probe
"""
