"""Soft-membership mixing: document rates whose expected domain token totals match targets.

A naive Bayes classifier over the labelled table gives each document a posterior over domains
(quality x toxicity). Nonnegative rates r_d then minimise || sum_d r_d t_d p_d - T ||^2, with t_d the
document's words, p_d its posterior and T the target totals, by projected gradient from
equal rates. A rate depends on p_d and on one small vector for each step, so a step is one aggregation over
(t_d, p_d) and nothing but that vector reaches the driver.

Documents without words have the prior as posterior and add no tokens. Null text counts as empty, null
doc_id is kept. Repeated rows are rated alike. Of a doc_id's labels the least domain counts. Labels with a null field are not used; with
no labels there is one domain `all`. Ties between domains go to the one that sorts first. Very long texts are read whole. An empty table
gives an empty table. Extra columns are kept as they are; those named like a result (n_words, p, rate, domain) are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: Bound on the labelled rows learned from (those with the least hash of doc_id), and on the vocabulary.
TRAIN_ROWS, VOCABULARY = 20_000, 256
#: How many words may pass for telling by chance, about: one that occurs by chance adds g to the log-likelihood with a probability of about exp(-g).
CHANCE_WORDS = 0.1
STEPS, TOLERANCE = 25, 1e-3
#: Share of all kept tokens wanted of each domain (q: quality, t: toxic), and kept tokens as a share of the input's.
TARGETS = {"q1t0": 0.95, "q0t0": 0.05, "q1t1": 0.0, "q0t1": 0.0}
KEEP = 0.5
#: Shape features, each cut into bins at these values.
SHAPES = {
    "symbols": (0.005, 0.02, 0.08),
    "upper": (0.1, 0.3, 0.6),
    "distinct": (0.2, 0.4, 0.6),
    "word_length": (3.0, 4.0, 8.0, 14.0),
    "words": (5, 20, 50, 400),
}


def _share(count: Column, of: Column) -> Column:
    return count.cast("double") / F.greatest(of, F.lit(1))


def _bin(value: Column, cuts: tuple) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(value >= c, 1).otherwise(0)
    return out


def features(docs: DataFrame) -> DataFrame:
    """docs plus tokens (n_words), terms (lower-cased words, with repeats) and a bin for each shape feature."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("list", F.array_remove(F.split(text, r"[\x20\x09-\x0D]++", -1), ""))
    out = out.withColumn("n_words", F.size("list").cast("long")).withColumn("terms", F.split(F.lower(text), r"[^a-z\x80-￿]++", -1))
    chars = F.length(text)
    out = out.withColumns(
        {
            "symbols": _bin(_share(chars - F.length(F.regexp_replace(text, "[#*$%&|<>!=]++", "")), chars), SHAPES["symbols"]),
            "upper": _bin(_share(chars - F.length(F.regexp_replace(text, "[A-Z]++", "")), chars), SHAPES["upper"]),
            "distinct": _bin(_share(F.size(F.array_distinct("list")), F.col("n_words")), SHAPES["distinct"]),
            "word_length": _bin(_share(chars, F.col("n_words")), SHAPES["word_length"]),
            "words": _bin(F.col("n_words"), SHAPES["words"]),
        }
    )
    return out.drop("list")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, vocabulary: int = VOCABULARY) -> dict:
    """Naive Bayes tables: domains, log-priors, log-odds of shape bins and of the most telling words.

    Only these bounded tables reach the driver: at most VOCABULARY words and a few dozen bins.
    """
    label = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("domain"))
    label = staged(label.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "labels")
    sample = staged(features(docs.select("doc_id", "text").join(F.broadcast(label), "doc_id")).drop("text").withColumn("terms", F.array_distinct("terms")), "labelled")
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {"domains": ["all"], "prior": [0.0], "shape": {}, "words": {}}
    domains, total = sorted(sizes), sum(sizes.values())
    model = {"domains": domains, "prior": [math.log(sizes[d] / total) for d in domains], "shape": {}, "words": {}}
    shapes = sample.select("domain", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("bin")) for k in SHAPES])).alias("x"))
    counts = {(r["domain"], r["k"], r["bin"]): r["n"] for r in shapes.groupBy("domain", "x.k", "x.bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    for k, cuts in SHAPES.items():
        model["shape"][k] = [[math.log((counts.get((d, k, b), 0) + 1) / (sizes[d] + len(cuts) + 1)) for d in domains] for b in range(len(cuts) + 1)]
    by = [F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{i}") for i, d in enumerate(domains)]
    words = staged(sample.select("domain", F.explode("terms").alias("word")).where("word <> ''").groupBy("word").agg(*by), "words")
    least = math.log(max(words.count(), 1) / CHANCE_WORDS)
    n = sum((F.col(f"n_{i}") for i in range(len(domains))), F.lit(0))
    gain = sum((F.col(f"n_{i}") * F.ln(((F.col(f"n_{i}") + 0.01) / (sizes[d] + 0.02)) / ((n + 0.01) / (total + 0.02))) for i, d in enumerate(domains)), F.lit(0.0))
    best = words.withColumn("n", n).withColumn("gain", gain).where(F.col("gain") >= least).orderBy(F.desc("gain"), "word").limit(vocabulary)
    for r in best.collect():
        model["words"][r["word"]] = [math.log((r[f"n_{i}"] + 0.1) / (sizes[d] + 0.2)) - math.log((r["n"] + 0.1) / (total + 0.2)) for i, d in enumerate(domains)]
    return model


def posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """docs plus n_words and p (array of posteriors, in the order of the model's domains); no shuffle."""
    found = features(docs)
    vector = lambda values: F.array(*[F.lit(float(v)) for v in values])
    score = [F.lit(x) for x in model["prior"]]
    for name, bins in model["shape"].items():
        score = [s + F.element_at(vector([row[i] for row in bins]), F.col(name) + 1) for i, s in enumerate(score)]
    found = found.withColumn("s", F.array(*score))
    if model["words"]:
        known = sorted(model["words"])
        table = F.create_map(*[x for w in known for x in (F.lit(w), vector(model["words"][w]))])
        found = found.withColumn("terms", F.array_intersect(F.col("terms"), F.array(*[F.lit(w) for w in known])))
        found = found.withColumn("s", F.aggregate("terms", F.col("s"), lambda acc, w: F.zip_with(acc, F.element_at(table, w), lambda a, b: a + b)))
    top = F.array_max("s")
    found = found.withColumn("e", F.transform("s", lambda x: F.exp(x - top)))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return found.withColumn("p", F.transform("e", lambda x: x / total)).drop("terms", "s", "e", *SHAPES)


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """Of a small positive matrix, by elimination with pivoting; a little is added to its diagonal."""
    k = len(m)
    ridge = 1e-9 * max(m[i][i] for i in range(k)) + 1e-12
    a = [[*row, *[float(i == j) for j in range(k)]] for i, row in enumerate(m)]
    for i in range(k):
        a[i][i] += ridge
    for i in range(k):
        at = max(range(i, k), key=lambda r: abs(a[r][i]))
        a[i], a[at] = a[at], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(k):
            if r != i:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i], strict=True)]
    return [row[k:] for row in a]


def _rate(start: float, moves: list[list[float]]) -> Column:
    """Rate after the moves. They are one array constant, so every step's plan has the same code, compiled once."""
    if not moves:
        return F.lit(float(start))

    def moved(rate: Column, move: Column) -> Column:
        return F.greatest(F.lit(0.0), rate - sum((F.col(f"p{i}") * move[i] for i in range(len(moves[0]))), F.lit(0.0)))

    return F.aggregate(F.array(*[F.array(*[F.lit(float(g)) for g in move]) for move in moves]), F.lit(float(start)), moved)


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float] | None = None, keep: float = KEEP, steps: int = STEPS) -> DataFrame:
    """members (n_words, p, ...) plus rate.

    Misses are weighed by the inverse of G = sum t_d p_d p_d^T, and a document by its words; in that
    metric the gradient for a document is p_d . G^-1 (A r - T) and its Lipschitz constant is 1, so
    the step is 1 and few steps are needed.
    """
    targets = TARGETS if targets is None else targets
    k = len(domains)
    base = members.withColumns({f"p{i}": F.col("p")[i] for i in range(k)}).withColumn("t", F.col("n_words").cast("double"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = base.agg(F.sum("t").alias("total"), *[F.sum(F.col("t") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    total = first["total"] or 0.0
    if total == 0:
        return members.withColumn("rate", F.lit(float(keep)))
    wanted = {d: targets.get(d, 0.0) for d in domains}
    scale = sum(wanted.values())
    goal = [keep * total * (wanted[d] / scale if scale else 1 / k) for d in domains]
    inverse = _inverse([[first[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    moves: list[list[float]] = []
    for _ in range(steps):
        weighed = F.col("t") * _rate(keep, moves)
        sums = base.agg(*[F.sum(weighed * F.col(f"p{i}")).alias(f"s{i}") for i in range(k)]).first()
        gap = [sums[f"s{i}"] - goal[i] for i in range(k)]
        move = [sum(x * g for x, g in zip(row, gap, strict=True)) for row in inverse]
        if max(abs(g) for g in gap) < TOLERANCE * keep * total or max(abs(x) for x in move) < TOLERANCE / 10:
            break
        moves.append(move)
    return base.withColumn("rate", _rate(keep, moves)).drop("t", *[f"p{i}" for i in range(k)])


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: float = KEEP) -> DataFrame:
    """docs (but text) plus n_words, p, rate and domain, the likeliest."""
    results = ("n_words", "p", "rate", "domain")
    others = [c for c in docs.columns if c not in (*results, "text")]
    model = fit(docs.select("doc_id", "text"), labels)
    members = staged(posteriors(docs.select("text", F.struct(F.lit(0).alias("none"), *others).alias("others")), model).select("others", "n_words", "p"), "members")
    rated = fit_rates(members, model["domains"], targets, keep)
    domain = F.element_at(F.array(*[F.lit(d) for d in model["domains"]]), F.array_position("p", F.array_max("p")).cast("int"))
    return rated.select(*[F.col(f"others.{c}").alias(c) for c in others], "n_words", "p", "rate", domain.alias("domain"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "domain", F.transform("p", lambda x: F.round(x, 6)).alias("posterior"), F.round("rate", 6).alias("rate"))
