"""Operator 4: personal data by candidate gradient boosting, with DataFrame and SQL functions only.

Four base kinds have fixed patterns and checks; they always count. Generators with loose patterns propose more spans, which
may overlap each other and the base ones. Boosted trees of each generator, fitted on those of all documents, score candidates by
format and context; they run as nested CASE expressions, and a threshold calibrated on held-out candidates selects those
that are added. The fit takes what could be added, candidates that overlap no base span: long keys behind a word such
as "token" are positive, anything else, such as a number that fails its check, is negative. Base matches in other
writings are positives too: addresses with [at], (at) or spaces, and phone numbers without country code behind a word
such as "phone"; real candidates of such forms are not used as negatives.

Cases: null text is empty; spans of different kinds may overlap; ids and other columns are never features, and columns
of any name pass through redact(); repeated rows get equal results; no rows, or no candidates to learn from: no
spans are added.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import delete_path, materialize

#: Patterns of the base kinds. Lookbehind and possessive quantifiers only keep long runs linear; matches are the same. A
#: card's run of digits is as long as it can be, so one with fewer than 16 digits, which fails, need not match at all.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "number": r"[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,40}",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,64}){0,8}",
    "key": r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9])",
}
CONTEXT = r"(?i)(token|key|secret|passw|phone|tel|call|card|mail|contact|account)"
FEATURES = ("n_digits", "n_chars", "n_marks", "luhn", "plus", "at", "n_dots", "n_letters", "context", "octets", "touches")
NAME, SITE = "substring_index(b.s, '@', 1)", "substring_index(b.s, '@', -1)"
NATIONAL = r"regexp_replace(b.s, r'^\+[0-9]{1,2}[\x20().-]*', '')"
#: Writings of a base match that only a generator finds: kind of the match, generator, text, text before.
DISGUISES = [
    ("email", "address", f"concat({NAME}, ' [at] ', replace({SITE}, '.', ' [dot] '))", "b.before"),
    ("email", "address", f"concat({NAME}, '(at)', replace({SITE}, '.', '(dot)'))", "b.before"),
    ("email", "address", f"concat({NAME}, ' [at] ', {SITE})", "b.before"),
    ("email", "address", f"concat({NAME}, ' @ ', {SITE})", "b.before"),
    ("phone", "number", f"concat('0', {NATIONAL})", "'phone '"),
    ("phone", "number", NATIONAL, "'phone '"),
]
#: A span: offsets in code points and in bytes, the text, and what stands around it.
SPAN = "struct<kind:string,start:int,end:int,lo:int,hi:int,s:string,before:string,after:string>"
#: Elements that one fold of scan_sql() appends to an array, which is copied each time.
CHUNK = 64
TREES, DEPTH, PRECISION = 10, 3, 0.95
#: Feature rows of one partition of a fit; decimals of a margin that the threshold tells apart.
PART, DECIMALS = 100_000, 3

OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"


def literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def let_sql(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan_sql(xs: str, zero: str, one: str, op: str, out: str, kind: str) -> str:
    """For every element x of the array xs `out`, of type `kind`, where a is the fold of all elements before it.

    zero starts the fold, one makes a value v of x, and op joins a and v; op is associative. Chunks are folded first, then
    what precedes each chunk, then the chunks from there: appending to one array would take the square of its size."""
    value = let_sql(one, "v", op)
    chunks = f"transform(sequence(0, greatest(size({xs}) - 1, 0) DIV {CHUNK}), k -> slice({xs}, CAST(k * {CHUNK} + 1 AS int), {CHUNK}))"
    totals = f"transform(cs, c -> aggregate(c, {zero}, (a, x) -> {value}))"
    starts = f"aggregate({totals}, struct({zero} AS a, array({zero}) AS out), (f, v) -> {let_sql('f.a', 'a', let_sql(op, 'n', 'struct(n AS a, array_append(f.out, n) AS out)'))}, f -> f.out)"
    inner = f"aggregate(c, struct(st[k] AS a, CAST(array() AS array<{kind}>) AS out), (f, x) -> {let_sql('f.a', 'a', f'struct({value} AS a, array_append(f.out, {out}) AS out)')}, f -> f.out)"
    return let_sql(chunks, "cs", let_sql(starts, "st", f"flatten(transform(cs, (c, k) -> {inner}))"))


def spans_sql(kind: str, pieces: str, gaps: str) -> str:
    """Matches and the text between them as spans with 24 characters of context."""
    cut = "struct(length(z.g[i]) AS g, length(m) AS n, octet_length(z.g[i]) AS gb, octet_length(m) AS nb, m AS s, right(z.g[i], 24) AS before, left(z.g[i + 1], 1) AS after)"
    xs = let_sql(f"struct({pieces} AS m, {gaps} AS g)", "z", f"transform(z.m, (m, i) -> {cut})")
    span = f"struct('{kind}' AS kind, a.c + x.g AS start, a.c + x.g + x.n AS end, a.b + x.gb AS lo, a.b + x.gb + x.nb AS hi, x.s AS s, x.before AS before, x.after AS after)"
    return let_sql(xs, "xs", scan_sql("xs", "struct(0 AS c, 0 AS b)", "struct(x.g + x.n AS c, x.gb + x.nb AS b)", "struct(a.c + v.c AS c, a.b + v.b AS b)", span, SPAN))


def fresh_sql() -> str:
    """The candidates that overlap no base span, in order: none that begins before the candidate ends after its start,
    and the next one begins at its end or later."""
    part = f"struct<start:int,c:int,end:int,x:{SPAN}>"
    both = f"array_sort(concat(transform(base, b -> struct(b.start AS start, 0 AS c, b.end AS end, CAST(NULL AS {SPAN}) AS x)), transform(candidates, d -> struct(d.start AS start, 1 AS c, d.end AS end, d AS x))))"
    past = scan_sql("both", "0", "IF(x.c = 0, x.end, 0)", "greatest(a, v)", "struct(x AS y, a AS last)", f"struct<y:{part},last:int>")
    ahead = scan_sql("back", "2147483647", "IF(x.y.c = 0, x.y.start, 2147483647)", "least(a, v)", "struct(x.y AS y, x.last AS last, a AS next)", f"struct<y:{part},last:int,next:int>")
    free = let_sql(f"reverse({past})", "back", f"transform(filter({ahead}, q -> q.y.c = 1 AND q.last <= q.y.start AND q.next >= q.y.end), q -> q.y.x)")
    return f"IF(size(base) = 0 OR size(candidates) = 0, candidates, {let_sql(both, 'both', f'reverse({free})')})"


def digits_sql(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def luhn_sql(s: str) -> str:
    """Whether the digits of s pass Luhn's check: from the right, every second digit is doubled, less 9 beyond 9."""
    d = digits_sql(s)
    value = f"CAST(substr(reverse({d}), k, 1) AS int)"
    doubled = f"2 * {value} - IF({value} > 4, 9, 0)"
    return f"(length({d}) BETWEEN 2 AND 40 AND aggregate(sequence(1, greatest(length({d}), 1)), 0, (t, k) -> t + IF(length({d}) = 0, 1, IF(k % 2 = 0, {doubled}, {value}))) % 10 = 0)"


def valid_sql(kind: str, s: str) -> str:
    n = f"length({digits_sql(s)})"
    return {"email": "true", "ip": f"{s} RLIKE {literal(OCTETS)}", "card": f"({n} BETWEEN 16 AND 19 AND {luhn_sql(s)})", "phone": f"{n} BETWEEN 8 AND 15"}[kind]


def found(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with base: array of spans with kind, and candidates: those of the generators. No other column of docs
    may have such a name: callers pack theirs into one."""
    text = F.coalesce("text", F.lit(""))
    # no match without these characters: such texts are not searched
    needs = dict.fromkeys(("ip", "card", "number"), text.rlike("[0-9]")) | {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "address": text.rlike(r"@|[(\[]at[)\]]")}
    patterns = BASE | GENERATORS
    rows = docs.select(*docs.columns, *(F.when(needs[k], text).otherwise("").alias(f"_t_{k}") if k in needs else text.alias(f"_t_{k}") for k in patterns))
    for kind, p in patterns.items():
        rows = rows.withColumns({f"_m_{kind}": F.expr(f"regexp_extract_all(_t_{kind}, {literal(p)}, 0)"), f"_g_{kind}": F.expr(f"split(_t_{kind}, {literal(p)})")})

    def of(kind: str) -> str:
        spans = spans_sql(kind, f"_m_{kind}", f"_g_{kind}")
        return f"filter({spans}, x -> {valid_sql(kind, 'x.s')})" if kind in BASE else spans

    rows = rows.withColumns({f"_s_{kind}": F.expr(of(kind)) for kind in patterns})
    rows = rows.withColumns({"base": F.concat(*[f"_s_{k}" for k in BASE]), "candidates": F.concat(*[f"_s_{k}" for k in GENERATORS])})
    return rows.drop(*[f"_{x}_{k}" for k in patterns for x in "tmgs"])


def features(c: Column) -> Column:
    """Small integers that describe a candidate's format and context."""
    s = c["s"]
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    alnum = "[A-Za-z0-9]"
    return F.struct(
        F.least(digits, F.lit(24)).alias("n_digits"),
        F.least(F.length(s), F.lit(64)).alias("n_chars"),
        F.least(F.length(s) - digits - letters, F.lit(12)).alias("n_marks"),
        F.call_function("luhn_check", F.regexp_replace(s, "[^0-9]", "")).cast("int").alias("luhn"),
        flag(s.startswith("+")).alias("plus"),
        flag(s.rlike(r"@|[(\[]at[)\]]")).alias("at"),
        F.least(F.length(F.regexp_replace(F.regexp_replace(s, r"[(\[]dot[)\]]", "."), r"[^.]", "")), F.lit(8)).alias("n_dots"),
        F.least(letters, F.lit(48)).alias("n_letters"),
        flag(c["before"].rlike(CONTEXT)).alias("context"),
        flag(s.rlike(OCTETS)).alias("octets"),
        flag(c["after"].rlike(alnum) | F.right(c["before"], F.lit(1)).rlike(alnum)).alias("touches"),
    )


def parse_tree(lines) -> tuple | float:
    """A tree of the model's printed form as (feature, limit, at most, above), leaves as numbers."""
    words = next(lines).strip().split()
    if words[0] == "Predict:":
        return float(words[1])
    feature, limit = int(words[2]), float(words[4].rstrip(")"))
    low = parse_tree(lines)
    next(lines)  # the Else line
    return feature, limit, low, parse_tree(lines)


def margin(model: list, f: Column) -> Column:
    """The boosted sum of a candidate's features, as nested CASE expressions."""

    def value(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        i, limit, low, high = tree
        return F.when(f[FEATURES[i]] <= limit, value(low)).otherwise(value(high))

    total = F.lit(0.0)
    for weight, tree in model:
        total = total + weight * value(tree)
    return total


def disguised() -> Column:
    """The base spans as candidates in the writings of DISGUISES, as far as the generator takes them whole."""
    forms = [f"struct('{kind}' AS of, struct('{g}' AS kind, b.start AS start, b.end AS end, b.lo AS lo, b.hi AS hi, {s} AS s, {before} AS before, '' AS after) AS c)" for kind, g, s, before in DISGUISES]
    whole = " OR ".join(f"(x.c.kind = '{g}' AND x.c.s RLIKE {literal('^(?:' + GENERATORS[g] + ')$')})" for g in ("address", "number"))
    return F.expr(f"transform(filter(flatten(transform(base, b -> array({', '.join(forms)}))), (x, i) -> base[CAST(i DIV {len(forms)} AS int)].kind = x.of AND ({whole})), x -> x.c)")


def train(docs: DataFrame, precision: float = PRECISION) -> dict[str, tuple[list, float]] | None:
    """Trees and margin threshold of each generator that has any to add, from the candidates of all documents.

    Equal feature rows are counted first, and the counts are written to the shared folder, because every tree reads them. One
    in five feature rows is held out: the threshold lies below the least margin whose selections are right in a share of
    `precision`, halfway to the next held-out one or 0.
    """
    both = F.concat(F.transform(F.expr(fresh_sql()), lambda c: F.struct(c.alias("c"), F.lit(False).alias("made"))), F.transform(disguised(), lambda c: F.struct(c.alias("c"), F.lit(True).alias("made"))))
    # outer, so that no filter on the size of what is to be unpacked is inferred, which would search each text twice
    rows = found(docs.select("text")).select(F.inline_outer(both)).filter("c IS NOT NULL")
    # what may be real data in another writing is no negative example
    f = features(F.col("c"))
    unsure = ((F.col("c.kind") == "number") & (f["context"] == 1) & (f["touches"] == 0)) | ((F.col("c.kind") == "address") & (f["n_dots"] > 0))
    rows = rows.filter(F.col("made") | ~unsure)
    positive = F.col("made") | ((F.col("c.kind") == "key") & F.col("c.before").rlike(CONTEXT))
    counts = rows.select("c.kind", features(F.col("c")).alias("f"), positive.cast("double").alias("label")).groupBy("kind", "f", "label").agg(F.count("*").cast("double").alias("weight"))
    paths = []
    try:
        shapes = materialize(counts.select("kind", *[F.col("f")[c].cast("double").alias(c) for c in FEATURES], "label", "weight"), "pii-shapes", paths)
        models = {kind: fit(shapes.filter(F.col("kind") == kind), precision) for kind in GENERATORS}
    finally:
        for path in paths:
            delete_path(docs.sparkSession, path)
    return {kind: m for kind, m in models.items() if m} or None


def fit(shapes: DataFrame, precision: float) -> tuple[list, float] | None:
    """Trees and threshold of one generator's feature rows."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(shapes.withColumn("held", F.pmod(F.xxhash64(*FEATURES), F.lit(5)) == 0))
    counts = {(r.held, r.label): r.n for r in data.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
    if len({label for _, label in counts}) < 2:
        return None
    n = sum(counts.values())
    fit_on = data.filter("NOT held") if len({label for held, label in counts if not held}) == 2 else data
    # splits are placed by all rows if these are no more than the square of the bins, else by a sample; no feature has 128 values
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=min(max(128, math.isqrt(n) + 1), 46_340), weightCol="weight", seed=7)
    fitted = gbt.fit(fit_on.coalesce(1 + n // PART))
    model = []
    for weight, tree in zip(fitted.treeWeights, fitted.trees):
        model.append((float(weight), parse_tree(iter(tree.toDebugString.splitlines()[1:]))))
    # some thousand rows at most: margins lie in a small range
    scored = data.filter("held").select(F.round(margin(model, F.struct(*FEATURES)), DECIMALS).alias("m"), "label", "weight").groupBy("m").agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("good"))
    right = total = 0.0
    threshold = None
    ranked = sorted(scored.collect(), key=lambda r: -r.m)
    for r, lower in zip(ranked, [x.m for x in ranked[1:]] + [0.0]):
        right, total = right + r.good, total + r.n
        if right >= precision * total and r.m > 0:
            threshold = (r.m + max(lower, 0.0)) / 2
    return (model, threshold) if threshold is not None else None


def spans(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with base and added: arrays of spans (kind, start, end, ...); added ones are scored, overlap no base span."""
    rows = found(docs)
    if model is None:
        return rows.withColumn("added", F.filter("candidates", lambda c: F.lit(False))).drop("candidates")
    rows = rows.withColumn("fresh", F.transform(F.expr(fresh_sql()), lambda c: F.struct(c.alias("c"), features(c).alias("f"))))

    def chosen_by(x: Column) -> Column:
        out = F.lit(False)
        for kind, (trees, threshold) in model.items():
            out = F.when(x["c"]["kind"] == kind, margin(trees, x["f"]) >= threshold).otherwise(out)
        return out

    chosen = F.filter("fresh", chosen_by)
    return rows.withColumn("added", F.transform(chosen, lambda x: x["c"])).drop("fresh", "candidates")


def listed(*columns: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.concat(*columns), text), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and the list of all spans."""
    docs = docs.select("doc_id", "text")
    rows = spans(docs, train(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    by_place = F.array_sort(F.transform("added", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    rows = rows.withColumn("added", by_place)
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(listed("base"), 256).alias("base_sha256"), F.concat_ws(",", F.nullif(listed("base"), F.lit("")), F.nullif(listed("added"), F.lit(""))).alias("spans"))


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; columns stay, n_chars follows the text.

    Overlapping spans are replaced as one, named after the first. Without a model one is trained on docs.
    """
    columns = docs.columns
    rows = spans(docs.select("text", F.struct(*[c for c in columns if c != "text"], F.lit(0).alias("text")).alias("doc")), model or train(docs))
    short = lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), F.upper(x["kind"]).alias("kind"))
    rows = rows.withColumn("all", F.array_sort(F.concat(F.transform("base", short), F.transform("added", short))))
    # by bytes, so that a piece is found without counting the characters before it; a is the end of all spans before x
    gap = "CAST(substr(raw, a + 1, x.lo - a) AS string)"
    pieces = scan_sql("all", "0", "x.hi", "greatest(a, v)", f"IF(x.hi <= a OR x.lo < a, '', concat({gap}, '[', x.kind, ']'))", "string")
    rest = "CAST(substr(raw, aggregate(all, 0, (a, x) -> greatest(a, x.hi)) + 1) AS string)"
    cut = let_sql("CAST(text AS binary)", "raw", f"concat(array_join({pieces}, ''), {rest})")
    rows = rows.withColumn("text", F.expr(f"IF(size(all) = 0, text, {cut})"))
    own = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    return rows.select(*(own.get(c, F.col("doc")[c]).alias(c) for c in columns))
