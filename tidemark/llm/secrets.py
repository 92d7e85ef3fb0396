"""Secret scan with multipart credential linking, in built-in expressions alone.

Strong kinds have a shape of their own. Weak ones (an identifier, something secret-looking, an endpoint) are reported
only where a complementary part stands apart from them in the same scope, at most SCOPE characters away. That is an
interval join by sorting: the ends of all complementary parts and the starts of weak ones are sorted together, so that a
weak part's rank says which end comes last before it, and likewise which start comes first after it. Every array here
belongs to one document, so nothing is shuffled, and no two parts of a document are compared but neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared

#: Characters between two parts that are linked, at most.
SCOPE = 200
MASK = "[SECRET]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # Java's syntax
    group: int  # the part whose length counts
    least: int
    gate: str  # a cheap necessary condition, as SQL over _text
    role: str | None = None  # of linking: what it is taken for
    weak: bool = False


# The patterns of the three strong kinds.
STRONG = [
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "(contains(_text, ':') or contains(_text, '='))", "secret"),
    Kind("access", "AKIA[A-Z0-9]+", 0, 16, "contains(_text, 'AKIA')", "id"),
    Kind("hex", "[0-9a-f]{32,}", 0, 32, "_text rlike '[0-9a-f]{32}'", "secret"),
]
_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
WEAK = [
    Kind("id", r"(?<![A-Za-z0-9])((?i:access_?key_?id|key_?id|client_?id|user_?name|user|login|account))" + _VALUE, 2, 4, "(contains(_text, ':') or contains(_text, '='))", "id", True),
    Kind("key", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}", 0, 20, "_text rlike '[A-Za-z0-9+/_-]{20}'", "secret", True),
    Kind("pass", r"(?<![A-Za-z0-9])((?i:pwd|pass|passphrase|credential|private_?key|auth|bearer))" + _VALUE, 2, 6, "(contains(_text, ':') or contains(_text, '='))", "secret", True),
    Kind("endpoint", r"(?<![A-Za-z0-9])((?i:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3))://[^\x20\x09-\x0D\"'<>]+", 0, 8, "contains(_text, '://')", "endpoint", True),
]
KINDS = [*STRONG, *WEAK]


def _found(df: DataFrame, kind: Kind, order: int) -> DataFrame:
    """Adds _s{order}: the kept matches of a kind as structs of start, order and end, in order.

    Texts between matches and matches give the lengths; starts are sums over the square root of their number.
    """
    pattern, gate, n = F.lit(kind.pattern), F.expr(kind.gate), f"_{order}"
    none = F.array().cast("array<string>")
    df = df.withColumns({
        f"_m{n}": F.when(gate, F.regexp_extract_all("_text", pattern, F.lit(0))).otherwise(none),
        f"_v{n}": F.when(gate, F.regexp_extract_all("_text", pattern, F.lit(kind.group))).otherwise(none),
    })
    df = df.withColumn(f"_p{n}", F.when(F.size(f"_m{n}") > 0, F.split("_text", kind.pattern, -1)).otherwise(none))
    steps = F.transform(f"_m{n}", lambda m, i: F.length(F.get(f"_p{n}", i)) + F.length(m))
    df = df.withColumns({f"_d{n}": steps, f"_b{n}": F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(f"_m{n}"))).cast("int"))})
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    span, blocks = F.col(f"_b{n}"), F.when(F.size(f"_d{n}") > 0, F.sequence(F.lit(0), F.floor((F.size(f"_d{n}") - 1) / F.col(f"_b{n}")).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(f"_k{n}", F.transform(blocks, lambda b: total(F.slice(f"_d{n}", b * span + 1, span))))
    df = df.withColumn(f"_q{n}", F.transform(f"_k{n}", lambda _, b: total(F.slice(f"_k{n}", F.lit(1), b))))

    def place(m: Column, i: Column) -> Column:
        b = F.floor(i / span).cast("int")
        start = F.get(f"_q{n}", b) + total(F.slice(f"_d{n}", b * span + 1, i - b * span)) + F.length(F.get(f"_p{n}", i))
        return F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + F.length(m)).alias("end"), F.length(F.get(f"_v{n}", i)).alias("size"))

    df = df.withColumn(f"_f{n}", F.filter(F.transform(f"_m{n}", place), lambda s: s["size"] >= kind.least))
    kept = F.transform(f"_f{n}", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return df.withColumn(f"_s{order}", kept).drop(*[f"_{c}{n}" for c in "mvpdbkqf"])


_PARTS = "array<struct<start:int,kind:int,end:int>>"


def _ranks(spans: Column, at: str, points: Column, equal: bool) -> Column:
    """For each of spans, in their order, how many points lie before its start or end (at), or upon it too (equal)."""
    none = F.lit(None).cast("int")
    queries = F.transform(spans, lambda s: F.struct(s[at].alias("at"), F.lit(1).alias("turn"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    marks = F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(0 if equal else 2).alias("turn"), none.alias("start"), none.alias("kind"), none.alias("end")))
    placed = F.transform(F.sort_array(F.concat(queries, marks)), lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), i.alias("i"), x["turn"].alias("turn")))
    own = F.filter(placed, lambda x: x["turn"] == 1)
    ranked = F.transform(own, lambda x, k: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), (x["i"] - k).alias("rank")))
    return F.transform(F.sort_array(ranked), lambda x: x["rank"])


def _points(spans: Column, at: str) -> Column:
    return F.sort_array(F.transform(spans, lambda s: s[at]))


def _apart(df: DataFrame, spans: str, others: Column) -> DataFrame:
    """df with only those of spans (sorted) that overlap none of others: as many begin before its end as end before its start."""
    df = df.withColumn("_others", others)
    df = df.withColumns({"_begun": _ranks(F.col(spans), "end", _points(F.col("_others"), "start"), False), "_ended": _ranks(F.col(spans), "start", _points(F.col("_others"), "end"), True)})
    kept = F.filter(spans, lambda s, i: F.get("_begun", i) == F.get("_ended", i))
    return df.withColumn(spans, kept).drop("_others", "_begun", "_ended")


def _linked(df: DataFrame, spans: str, others: Column, name: str) -> DataFrame:
    """df with name: those of spans (sorted) that have one of others before or after them in their scope, without overlap."""
    df = df.withColumns({"_ends": _points(others, "end"), "_starts": _points(others, "start")})
    df = df.withColumns({"_before": _ranks(F.col(spans), "start", F.col("_ends"), True), "_after": _ranks(F.col(spans), "end", F.col("_starts"), False)})

    def near(s: Column, i: Column) -> Column:
        before, after = s["start"] - F.get("_ends", F.get("_before", i) - 1), F.get("_starts", F.get("_after", i)) - s["end"]
        return (F.coalesce(before, F.lit(SCOPE + 1)) <= SCOPE) | (F.coalesce(after, F.lit(SCOPE + 1)) <= SCOPE)

    return df.withColumn(name, F.filter(spans, near)).drop("_ends", "_starts", "_before", "_after")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base and spans: arrays of structs (start, kind, end), by start, then kind; kind counts in KINDS.

    base has the strong spans, spans also the weak ones that overlap no strong one and have a complementary part, strong
    or weak, in their scope: a secret needs an identifier or an endpoint, these need a secret. A part is never its own
    counterpart, nor is what overlaps it; an address is no key. Offsets are code points, the end exclusive. Whole texts
    are scanned, however long; null ones count as empty and have no spans. Rows are independent: repeated ones have
    equal results, no rows give none. All other columns stay; columns named base or spans are replaced.
    """
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for order, kind in enumerate(KINDS):
        df = _found(df, kind, order)
    of = lambda good: F.sort_array(F.concat(F.array().cast(_PARTS), *[F.col(f"_s{i}") for i, k in enumerate(KINDS) if good(k)]))
    df = df.withColumns({"base": of(lambda k: not k.weak), "_keys": of(lambda k: k.name == "key"), "_sites": of(lambda k: k.role == "endpoint")})
    df = _apart(df, "_keys", F.col("_sites"))
    df = df.withColumns({"_weak_secret": F.sort_array(F.concat("_keys", of(lambda k: k.weak and k.role == "secret" and k.name != "key"))), "_weak_other": of(lambda k: k.weak and k.role != "secret")})
    for spans in ("_weak_secret", "_weak_other"):
        df = _apart(df, spans, F.col("base"))
    strong = lambda good: F.filter("base", lambda s: s["kind"].isin([i for i, k in enumerate(KINDS) if not k.weak and good(k)]))
    df = df.withColumns({"_secrets": F.concat("_weak_secret", strong(lambda k: k.role == "secret")), "_partners": F.concat("_weak_other", strong(lambda k: k.role != "secret"))})
    df = _linked(df, "_weak_secret", F.col("_partners"), "_linked_secret")
    df = _linked(df, "_weak_other", F.col("_secrets"), "_linked_other")
    df = df.withColumn("spans", F.sort_array(F.concat("base", "_linked_secret", "_linked_other")))
    return df.drop("_text", "_keys", "_sites", "_weak_secret", "_weak_other", "_secrets", "_partners", "_linked_secret", "_linked_other", *[f"_s{i}" for i in range(len(KINDS))])


def written(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """docs with each stretch of text under spans of secrets and identifiers replaced by mask; n_chars, where there is one, follows.

    Addresses stay. Texts without spans, null ones too, stay as they are. No row is dropped.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("text"))
    hidden = [i for i, k in enumerate(KINDS) if k.role != "endpoint"]
    df = scan(whole).withColumn("spans", F.filter("spans", lambda s: s["kind"].isin(hidden)))
    # Overlapping spans become one: a stretch begins where no earlier span reaches, and ends at the farthest end so far.
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= s["start"]),
            F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    df = df.withColumn("_stretches", merged)
    since = lambda i: F.coalesce(F.get("_stretches", i - 1)["end"], F.lit(0))
    parts = F.transform("_stretches", lambda s, i: F.substring(F.col("text"), since(i) + 1, s["start"] - since(i)))
    tail = F.substring(F.col("text"), since(F.size("_stretches")) + 1, F.length("text"))
    df = df.withColumn("_masked", F.when(F.size("spans") > 0, F.array_join(F.concat(parts, F.array(tail)), mask)).otherwise(F.col("text")))
    out = df.withColumn("_row", F.col("_row").withField(text, F.col("_masked"))).select("_row.*")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(shared.read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [shared.count_of("base", "kind", i).alias(f"n_{k.name}") for i, k in enumerate(STRONG)]
    return rows.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
