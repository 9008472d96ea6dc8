"""Mixing to target weights with soft membership; DataFrame functions only.

A labelled table names the domain of some documents. A naive Bayes classifier on hashed words, runs of
punctuation and the text's form (shares of capitals, of symbols and of repeated words), each counted once per
document over all labelled documents, gives every document a posterior over domains. Projected
gradient descent then fits nonnegative rates of the documents so that the expected tokens of each
domain meet the targets: least squares over domains, each weighted by the tokens it has. A step
needs the domain totals only, and a document's rate is a nested expression of its posterior and the
totals of the steps before, so nothing but one row of totals per step reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import ascii_lower, stored, table

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.93, "poor": 0.05, "toxic": 0.02}
#: Buckets of the classifier's words: bounds the broadcast weights at 2^18 rows of four numbers (about 10 MB).
BUCKETS = 1 << 18


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain; toxic wins over poor, poor over good, null flags count as good."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    domain = F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "poor").otherwise("good")
    return one.select("doc_id", domain.alias("domain"))


def _share(part: Column, whole: Column, name: str) -> Column:
    """A word that names the share in steps that double: none, up to 1/64, 1/32 ... 1."""
    step = F.when(part <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log2(part / whole)) + 7))
    return F.when(whole > 0, F.concat(F.lit(name + "="), step.cast("string")))


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the buckets of the text's distinct features: words, runs of punctuation behind a blank, named shares."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim("text"), r"\s+")))
    found = docs.select("doc_id", F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"),
                        F.split(ascii_lower(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+").alias("words"),
                        F.split(text, r"[A-Za-z0-9\s\x{80}-\x{10FFFF}]+").alias("marks"), F.length(text).alias("size"),
                        (F.size(F.split(text, "[A-Z]")) - 1).alias("capitals"))
    found = found.select("*", F.array_distinct("words").alias("once"))
    shares = F.array(_share(F.col("capitals"), F.col("size"), "=capitals"),
                     _share(F.size("words") - F.size("once"), F.size("words"), "=repeats"),
                     _share(F.size("marks") - 2, F.col("size"), "=marks"))
    marks = F.transform(F.filter(F.array_distinct("marks"), lambda m: m != ""), lambda m: F.concat(F.lit(" "), m))
    words = F.concat(F.filter("once", lambda w: w != ""), marks, F.when(F.size("words") > 1, shares).otherwise(F.array().cast("array<string>")))
    buckets = F.transform(F.array_compact(words), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    return found.select("doc_id", "n_tokens", buckets.alias("buckets"))


def word_weights(features: DataFrame, labelled: DataFrame, least_z: float = 3.0) -> tuple[DataFrame, list[float]]:
    """Log likelihoods of the buckets that tell domains apart, and the log priors."""
    # The same join at every size: what is shuffled are buckets, and they grow with the input.
    known = features.select("doc_id", "buckets").join(labelled.hint("merge"), "doc_id")
    sums = [F.sum((F.col("domain") == d).cast("long")).alias(d) for d in DOMAINS]
    counts = stored(known.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*sums), "bucket-counts")
    total = counts.agg(*[F.sum(d).alias(d) for d in DOMAINS]).first()
    totals = [float(total[d] or 0) for d in DOMAINS]
    every = sum(totals) or 1.0
    rows = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    priors = [(rows.get(d, 0) + 1) / (sum(rows.values()) + len(DOMAINS)) for d in DOMAINS]
    n = sum((F.col(d) for d in DOMAINS), F.lit(0))
    z = [F.abs(F.col(d) - n * (t / every)) / F.sqrt(n * (t / every) + 1.0) for d, t in zip(DOMAINS, totals, strict=True)]
    # A domain without labelled words has the words of all: it is told apart by its prior alone.
    logs = [(F.log((F.col(d) + 5.0 * n / every * t / F.greatest(n, F.lit(1.0)) + 1e-3) / (t + 5.0 * t / every)) if t else F.log(n / every)).alias(d)
            for d, t in zip(DOMAINS, totals, strict=True)]
    return counts.where(F.greatest(*z) >= least_z).select("bucket", *logs), priors


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens and p_<domain> of each doc_id. Texts without telling words get the priors."""
    labelled = label_domains(labels)
    # Texts are split once; both the classifier and the posteriors read the stored buckets.
    features = stored(_features(docs), "features")
    weights, priors = word_weights(features, labelled)
    hits = features.select("doc_id", F.explode("buckets").alias("bucket")).join(F.broadcast(weights), "bucket")
    found = hits.groupBy("doc_id").agg(*[F.sum(d).alias(d) for d in DOMAINS])
    scored = features.select("doc_id", "n_tokens").join(found.hint("merge"), "doc_id", "left")
    score = [F.coalesce(d, F.lit(0.0)) + F.log(F.lit(p)) for d, p in zip(DOMAINS, priors, strict=True)]
    scored = scored.select("doc_id", "n_tokens", *[s.alias(d) for s, d in zip(score, DOMAINS, strict=True)])
    scored = scored.withColumn("_m", F.greatest(*DOMAINS))
    parts = [F.exp(F.col(d) - F.col("_m")) for d in DOMAINS]
    return scored.select("doc_id", "n_tokens", *[(p / sum(parts[1:], parts[0])).alias(f"p_{d}") for p, d in zip(parts, DOMAINS, strict=True)])


def fit_rates(soft: DataFrame, targets: dict[str, float] | None = None, budget: float = 0.5, most: float = 4.0,
              steps: int = 40, tolerance: float = 1e-4) -> Column:
    """Rate of a row of soft (n_tokens, p_*) in [0, most]; expected tokens of domain d meet targets[d] * budget * all tokens."""
    targets = targets or TARGETS
    p = [F.col(f"p_{d}") for d in DOMAINS]
    rate: Column = F.lit(budget)
    first = soft.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * x).alias(d) for x, d in zip(p, DOMAINS, strict=True)]).first()
    every = float(first["n"] or 0)
    if not every:
        return rate
    mass = [max(float(first[d] or 0), 1e-9 * every) for d in DOMAINS]
    goals = [targets.get(d, 0.0) * budget * every for d in DOMAINS]
    for _ in range(steps):
        row = soft.agg(*[F.sum(F.col("n_tokens") * x * rate).alias(d) for x, d in zip(p, DOMAINS, strict=True)]).first()
        gaps = [float(row[d] or 0) - g for d, g in zip(DOMAINS, goals, strict=True)]
        if max(abs(g) for g in gaps) <= tolerance * budget * every:
            break
        move = sum((x * F.lit(g / m) for x, g, m in zip(p[1:], gaps[1:], mass[1:], strict=True)), p[0] * F.lit(gaps[0] / mass[0]))
        rate = F.least(F.lit(most), F.greatest(F.lit(0.0), rate - move))
    return rate


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 0.5, most: float = 4.0) -> DataFrame:
    """One row per document row: doc_id, n_tokens, p_<domain>, domain (most probable) and rate.

    Null and empty texts have no tokens, the prior posteriors and the rate these imply; without labels
    all documents get equal posteriors; labels without document are ignored. Rows repeated with one
    doc_id pool their words for the posterior and each get a row. A domain that no label names keeps its small prior. Empty tables give no rows; other
    columns are not read. Targets that the rates cannot reach within [0, most] are met in least squares.
    """
    soft = stored(posteriors(docs, labels), "posteriors")
    best = F.greatest(*[f"p_{d}" for d in DOMAINS])
    domain = F.coalesce(*[F.when(F.col(f"p_{d}") == best, d) for d in DOMAINS])
    return soft.select("*", domain.alias("domain"), fit_rates(soft, targets, budget, most).alias("rate"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "labels"))
