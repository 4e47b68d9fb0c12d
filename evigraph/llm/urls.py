"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import written

# Verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Labelled URLs the trees are fitted on, at most about this many (those with the smallest hashes).
TRAIN_ROWS = 100_000
TREES = 20
DEPTH = 4
STEP = 0.2
THRESHOLD = 0.5
# Weight of the overall rate in a part's rate, in rows.
PRIOR = 20
# Distinct characters whose share enters the entropy one by one; all others are one class.
ALPHABET = string.ascii_letters + string.digits + "-._~:/?#[]@!$&'()*+,;=%"
# Parts of a URL with a block rate of their own.
PARTS = ["top", "site", "folder", "ending"]
FEATURES = [
    "length", "host_length", "host_depth", "path_depth", "digits", "host_digits", "marks", "parameters", "fragment", "secure", "entropy",
    *[f"{p}_rate" for p in PARTS], *[f"{p}_rows" for p in PARTS],
]


def _lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: str) -> dict[str, Column]:
    """``host`` (after the first ://, lower-cased) and ``path`` of a URL column; both empty without ://."""
    whole = F.coalesce(F.col(url), F.lit(""))
    mark = F.instr(whole, "://")
    rest = F.when(mark > 0, F.substring(whole, mark + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return {"host": _lower(host), "path": path}


def rule_of(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host and path together, ties by verdict and text) that fits ``host, path``: a struct ``verdict, rule`` or null."""
    fits = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path),
            F.struct(F.lit(verdict).alias("verdict"), F.lit(host + path).alias("rule")),
        )
        for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<verdict:string,rule:string>"))


def _share(c: Column, pattern: str) -> Column:
    """Part of a text's characters that match a character class."""
    n = F.length(c)
    return F.when(n > 0, (n - F.length(F.regexp_replace(c, pattern, ""))) / n).otherwise(F.lit(0.0))


def _entropy(c: Column) -> Column:
    """Bits per character, from the counts of the characters of ``ALPHABET`` and of the rest as one class."""
    n = F.length(c)
    counts = F.transform(F.split(F.lit("\x00".join(ALPHABET)), "\x00"), lambda a: n - F.length(F.replace(c, a, F.lit(""))))
    known = F.aggregate(counts, F.lit(0), lambda s, x: s + x)
    bits = lambda x: F.when(x > 0, -x / n * F.log2(x / n)).otherwise(F.lit(0.0))
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s + bits(x)) + bits(n - known)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, the lexical features and a 64-bit key for each part in ``PARTS``.

    Parts are the host's last label, its last two labels, the path's first folder and the ending of its
    last name. A key stands for the part's text, so that a table of parts has a known row size.
    """
    whole = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    top = F.element_at(labels, -1)
    texts = {
        "top": top,
        "site": F.concat_ws(".", F.try_element_at(labels, F.lit(-2)), top),
        "folder": F.regexp_extract("path", "^/([^/]*)/", 1),
        "ending": _lower(F.regexp_extract("path", r"\.([^./]*)$", 1)),
    }
    return (
        urls.withColumns(split_url(url))
        .withColumns(
            {
                "length": F.length(whole),
                "host_length": F.length("host"),
                "host_depth": F.size(labels),
                "path_depth": F.length("path") - F.length(F.regexp_replace("path", "/", "")),
                "digits": _share(whole, "[0-9]"),
                "host_digits": _share(F.col("host"), "[0-9]"),
                "marks": _share(whole, "[^A-Za-z0-9]"),
                "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
                "fragment": F.contains(whole, F.lit("#")).cast("int"),
                "secure": F.startswith(_lower(F.substring(whole, 1, 6)), F.lit("https:")).cast("int"),
                "entropy": _entropy(whole),
            }
            | {f"{name}_key": F.xxhash64(F.lit(name), text) for name, text in texts.items()}
        )
    )


def part_rates(labelled: DataFrame) -> DataFrame:
    """``part, fold, rows, blocked`` of labelled rows (``fold, blocked`` and the part keys).

    At most four rows per labelled row, and the labelled rows are bounded by ``TRAIN_ROWS``.
    """
    parts = F.explode(F.array(*[F.col(f"{p}_key") for p in PARTS]))
    return labelled.select("fold", "blocked", parts.alias("part")).groupBy("part", "fold").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("blocked").alias("blocked")
    )


def with_rates(rows: DataFrame, rates: DataFrame, overall: float) -> DataFrame:
    """Add rate and row count of every part. ``rates`` has ``part, rows, blocked`` and, to match on, maybe ``fold``."""
    keys = ["fold"] if "fold" in rates.columns else []
    for p in PARTS:
        # a stated number of rows of 32 bytes: four for each of at most TRAIN_ROWS fitted rows
        side = F.broadcast(rates.select(F.col("part").alias(f"{p}_key"), *keys, F.col("rows").alias("_rows"), F.col("blocked").alias("_blocked")))
        rows = rows.join(side, [f"{p}_key", *keys], "left")
        n, b = F.coalesce("_rows", F.lit(0)), F.coalesce("_blocked", F.lit(0))
        rows = rows.withColumns({f"{p}_rate": (b + PRIOR * overall) / (n + PRIOR), f"{p}_rows": F.log1p(n)}).drop("_rows", "_blocked")
    return rows


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[GBTClassificationModel | None, DataFrame | None, float]:
    """Trees, part rates and block rate from labelled URLs: ``url, blocked`` (0 or 1; a null label is no label).

    Each distinct URL is one training row (with contradicting labels: the one most rows give, a tie
    blocks). Labels are bounded by ``rows``: of more, those whose hash falls below the share are taken,
    so about that many, the same in each run. With labels of one kind only there are no trees and the
    block rate, 0 or 1, decides; with none it is 0.

    A training row sees the part rates of the other half of the labelled URLs, never its own label.
    """
    usable = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select("url", F.col("blocked").cast("int").alias("blocked"))
    found = usable.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    # a share of the hashes, not an order
    draw = F.xxhash64(F.lit("draw"), "url") / F.lit(2.0**64) + F.lit(0.5)
    bounded = (usable.where(draw < rows / found) if found > rows else usable).groupBy("url").agg(
        (2 * F.sum("blocked") >= F.count(F.lit(1))).cast("int").alias("blocked")
    )
    sample = written(lexical(bounded).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(2)).cast("int")))
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("blocked")).first()
    overall = (total["blocked"] or 0) / max(total["n"], 1)
    if overall in (0, 1):
        return None, None, overall
    rates = written(part_rates(sample))
    others = rates.withColumn("fold", 1 - F.col("fold"))
    learning = written(_vectors(with_rates(sample, others, overall)).select(F.col("blocked").cast("double").alias("label"), "_features"))
    trees = GBTClassifier(
        labelCol="label", featuresCol="_features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, minInstancesPerNode=5, seed=7
    )
    whole = rates.groupBy("part").agg(F.sum("rows").alias("rows"), F.sum("blocked").alias("blocked"))
    return trees.fit(learning), written(whole), overall


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``page_id, url``.

    ``host`` runs from the first :// to the next /, ? or # (A-Z lower-cased), ``path`` from there to ? or
    #; both are empty for a null URL or one without ://. A rule ``(verdict, host, path)`` fits its host
    and all subdomains when the path starts with the rule's; the longest decides. All other rows are
    judged by gradient-boosted trees fitted on ``labelled`` (``url, blocked``); ``score`` is their
    probability of a block for every row, with or without a rule, and from ``THRESHOLD`` on they block.
    The rules are a short stated list. Null, empty and very long URLs are judged like any other,
    repeated rows each get their row, other columns are ignored, an empty table gives no rows.

    One scan without a shuffle: features, rates (a bounded broadcast) and trees are computed where the
    URLs lie.
    """
    model, rates, overall = train(labelled, rows)
    base = lexical(pages.select("page_id", "url")).withColumn("_rule", rule_of(rules if rules is not None else RULES))
    if model is None:
        scored = base.withColumn("score", F.lit(float(overall)))
    else:
        scored = model.transform(_vectors(with_rates(base, rates, overall))).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "score")


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``url, blocked`` of the URLs that a rule decides."""
    ruled = pages.select("url", *[c.alias(n) for n, c in split_url("url").items()]).withColumn("_rule", rule_of(rules if rules is not None else RULES))
    return ruled.where(F.col("_rule").isNotNull()).select("url", (F.col("_rule.verdict") == "block").cast("int").alias("blocked"))
