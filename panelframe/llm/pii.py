"""Personal data: fixed formats plus bootstrapped contextual extraction, all in Catalyst expressions.

Base spans come from four patterns. They, and tokens of the shape of keys, are the seeds. What stands around a value makes its lexical
patterns: the two words before it, the one before it, and four letters it begins with. Patterns and the candidate identifiers they mark
form a weighted bipartite graph, and a few rounds of scoring tell which patterns mark identifiers only. High-confidence patterns
then discover identifiers that no base pattern knows (kind `ctx`).

Positions are code points, end exclusive. They are found without leaving the JVM: split() gives the
text between matches, regexp_extract_all() the matches, and running sums of their lengths give the
offsets. Null text counts as empty: no span. Null doc_id stays null. Repeated rows are judged independently, and of equal values one counts
in the graph. Very long texts are searched whole. An empty table gives an empty table. Extra columns are kept as they are; those named like
a result (email, ip, card, phone, ctx) are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged

KINDS = ("email", "ip", "card", "phone")
#: The fixed formats as Java patterns that cannot backtrack far: runs are possessive, and a match may
#: begin only where a run begins (or where the match before ended), which is where the leftmost
#: match begins anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Signs of a candidate identifier: a token of at least six with a digit, without the punctuation it ends with.
SIGNS = "A-Za-z0-9@._:/#+-"
CANDIDATE = rf"(?<![{SIGNS}])(?=[{SIGNS}]{{6}})[A-Za-z@._:/#+-]*+[0-9](?:[{SIGNS}]*[A-Za-z0-9])?"
#: The shape of keys: letters and digits mixed, sixteen or more. Such candidates are seeds beside the fixed formats.
KEY_SHAPE = r"^(?=(?:[^0-9]*[0-9]){2})(?=(?:[^A-Za-z]*[A-Za-z]){2})[A-Za-z0-9]{16,}$"
CONTEXT_CHARS = 48
#: Rounds of scoring; how sure a pattern must be; how many different seeds it must precede.
ROUNDS, MIN_CONFIDENCE, MIN_SEEDS = 3, 0.8, 3


SPANS = "array<struct<start:int,end:int,value:string,before:string>>"


def none() -> Column:
    return F.array().cast(SPANS)


def _located(found: Column, gaps: Column) -> Column:
    """Array of (start, end, value, before) from the matches and the text between them."""

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    pairs = F.arrays_zip(found.alias("value"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none().alias("spans")), add, lambda acc: acc["spans"])


def with_matches(docs: DataFrame, patterns: dict[str, str], only_if: dict[str, Column]) -> DataFrame:
    """Adds a column of located leftmost non-overlapping matches for each pattern.

    Matches, gaps and offsets are made in three projections: each refers to the one before more than
    once, so the optimizer keeps them apart and every regular expression runs once a text, and the
    later two run for texts with a match only.
    """
    keys = list(patterns)
    out = docs.withColumns({f"f_{k}": F.when(only_if[k], F.regexp_extract_all("text", F.lit(patterns[k]), F.lit(0))) for k in keys})
    out = out.withColumns({f"g_{k}": F.when(F.size(f"f_{k}") > 0, F.split("text", patterns[k], -1)) for k in keys})
    out = out.withColumns({k: F.when(F.size(f"f_{k}") > 0, _located(F.col(f"f_{k}"), F.col(f"g_{k}"))).otherwise(none()) for k in keys})
    return out.drop(*[f"{x}_{k}" for k in keys for x in "fg"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.length(digits))

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda x: F.length(F.ltrim(x, F.lit("0"))).between(0, 3) & (F.right(F.concat(F.lit("000"), x), F.lit(3)).cast("int") <= 255)),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}
#: What a text must contain for a match of each kind; it spares most texts the patterns.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def _value_test(valid):
    return lambda x: valid(x["value"])


def _named(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"])


def _marked(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus_end"), F.lit(f"<{kind.upper()}>").alias("mark"))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (text, others) with text made non-null, an array column for each kind, and `token`, the candidate identifiers."""
    out = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digits", F.rlike("text", F.lit("[0-9]")))
    needs = {k: F.contains("text", F.lit(v)) & (F.lit(True) if k == "email" else F.col("digits")) for k, v in NEEDS.items()}
    out = with_matches(out, PATTERNS | {"token": CANDIDATE}, needs | {"token": F.col("digits")})
    return out.withColumns({k: F.when(F.size(k) > 0, F.filter(k, _value_test(VALID[k]))).otherwise(none()) for k in KINDS}).drop("digits")


def _contexts(before: Column, value: Column) -> Column:
    """The lexical patterns of a value, lower-cased: the last two words before it, the last one, and the four letters it begins with."""
    words = F.regexp_extract_all(F.regexp_extract(before, r"(?:\S+\s+)?\S+\s*$", 0), F.lit(r"\S+"), F.lit(0))
    two = F.when(F.size(words) == 2, F.concat(F.lit("2 "), F.array_join(words, " ")))
    one = F.when(F.size(words) > 0, F.concat(F.lit("1 "), F.element_at(words, -1)))
    begins = F.concat(F.lit("0 "), F.nullif(F.regexp_extract(value, "^[A-Za-z]{4}", 0), F.lit("")))
    return F.transform(F.array_compact(F.array(two, one, begins)), F.lower)


def seeds_and_candidates(docs: DataFrame) -> DataFrame:
    """Weighted edges (context, value hash, seed, n) of the pattern-instance graph, aggregated before the shuffle."""
    based = base_spans(docs)

    def edge(seed):
        return lambda x: F.struct(_contexts(x["before"], x["value"]).alias("contexts"), F.xxhash64(x["value"]).alias("value"), seed(x["value"]).alias("seed"))

    seen = F.concat(*[F.transform(k, edge(lambda v: F.lit(True))) for k in KINDS], F.transform("token", edge(lambda v: F.rlike(v, F.lit(KEY_SHAPE)))))
    found = based.where(" or ".join(f"size({k}) > 0" for k in (*KINDS, "token"))).select(F.explode(seen).alias("x"))
    edges = found.select(F.explode("x.contexts").alias("context"), "x.value", "x.seed")
    return edges.groupBy("context", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """Contexts whose instances are identifiers.

    An instance starts at 1 if it is a seed and 0 else. A pattern's score is the mean over its
    distinct instances; an unseen instance's score is one minus the chance that all its patterns
    err. Each round is two aggregations over edges; hot values and contexts are combined before
    the shuffle.
    """
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for i in range(rounds):
        pattern = scored.groupBy("context").agg(F.avg("score").alias("confidence"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        if i == rounds - 1:
            return pattern.where((F.col("confidence") >= min_confidence) & (F.col("seeds") >= min_seeds))
        strong = pattern.where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= min_confidence / 2))
        value = scored.join(strong.select("context", "confidence"), "context").groupBy("value").agg((1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("by_patterns"))
        scored = scored.select("context", "value", "seed").join(value, "value", "left").select("context", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("by_patterns", F.lit(0.0))).alias("score"))
    raise ValueError("rounds must be positive")


#: Up to this many patterns their hashes are part of the plan (eight bytes each); beyond it they are joined. Both ways find the same.
PLAN_PATTERNS = 20_000


def personal_data(docs: DataFrame) -> DataFrame:
    """docs plus an array column for each kind and `ctx`, the identifiers found by their context."""
    results = (*KINDS, "ctx")
    edges = staged(seeds_and_candidates(docs.select("text")), "pii-edges")
    patterns = staged(confident_patterns(edges).select(F.xxhash64("context").alias("pattern")).distinct(), "pii-patterns")
    discard(edges)
    based = base_spans(docs.select("text", F.struct(F.lit(0).alias("none"), *[c for c in docs.columns if c not in (*results, "text")]).alias("others"), F.col("text").alias("own")))
    taken = F.concat(*[F.transform(F.col(k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS])
    free = F.filter("token", lambda x: ~F.exists(taken, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    hashes = lambda x: F.transform(_contexts(x["before"], x["value"]), lambda c: F.xxhash64(c))
    based = based.withColumn("token", free)
    if patterns.count() <= PLAN_PATTERNS:
        known = [r["pattern"] for r in patterns.collect()]
        out = based.withColumn("ctx", F.filter("token", lambda x: F.exists(hashes(x), lambda h: h.isin(known)))) if known else based.withColumn("ctx", none())
    else:
        keyed = based.withColumn("row", F.monotonically_increasing_id())
        marked = keyed.select("row", F.explode("token").alias("x")).select("row", "x", F.explode(hashes(F.col("x"))).alias("pattern")).join(patterns, "pattern", "leftsemi")
        hits = marked.groupBy("row").agg(F.array_sort(F.collect_set("x")).alias("ctx"))
        out = keyed.join(hits, "row", "left").withColumn("ctx", F.coalesce("ctx", none()))
    return out.select(*[F.col("own" if c == "text" else f"others.{c}").alias(c) for c in docs.columns if c not in results], *results)


def span_list(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of every span, comma-joined, by kind as listed and then by start."""
    return F.array_join(F.concat(*[F.transform(F.col(k), _named(k)) for k in kinds]), ",")


def redact(found: DataFrame) -> Column:
    """The text with every span replaced by its kind in brackets. Of overlapping spans the one that starts first (then the longer) comes first;
    what another has beyond its end is replaced by that one's kind, and a span inside another has no mark of its own."""
    spans = F.array_sort(F.concat(*[F.transform(F.col(k), _marked(k)) for k in (*KINDS, "ctx")]))  # none where text is null

    def add(acc: Column, x: Column) -> Column:
        between = F.substr(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        more = F.concat(acc["out"], between, x["mark"])
        return F.when(-x["minus_end"] <= acc["at"], acc).otherwise(F.struct((-x["minus_end"]).alias("at"), more.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, F.col("text")).otherwise(F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text")))))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(span_list(KINDS), 256).alias("base_sha256"),
        span_list((*KINDS, "ctx")).alias("spans"),
        sum((F.size(k) for k in (*KINDS, "ctx")), F.lit(0)).cast("long").alias("n_spans"),
    )
