"""URL filtering: rules first, then gradient-boosted trees on lexical features.

A rule is a host with a path prefix (``example.org/es/``); it fits its host
and all subdomains where the path starts with the rule's.  The longest fitting
rule decides.  Urls that no rule fits are judged by boosted trees over
lexical features: lengths, depth, digit ratio, character entropy, parameter
counts, and statistics of the url's suffixes (how common they are among all
pages, and how often labelled urls with them were blocked).  The trees are
trained from labelled urls; by default those are the urls that rules decide.

Defined cases: a null url, or one without ``://``, has an empty host and
path; of equally long fitting rules a blocking one wins; without labelled
urls of both kinds every other url gets the only kind there is, or is
allowed; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations


from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import pick
from quarry.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bound of the training sample: about so many distinct labelled urls are drawn by hash.
MAX_TRAINING_URLS = 50_000
#: Weight, in urls, of the overall block rate in a suffix's rate.
PRIOR_URLS = 20.0
TREES, DEPTH = 20, 4
#: A training url's suffix rates come from the other folds.
FOLDS = 5
LEXICAL = ("url_length", "host_length", "host_depth", "path_length", "path_depth", "digit_ratio", "host_digits",
           "hyphens", "entropy", "path_entropy", "parameters", "query_length", "has_fragment", "longest_segment")
SUFFIXES = ("top_label", "two_labels", "extension", "first_segment")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    none = F.lit(None).cast("string")
    order = sorted(rules, key=lambda r: (-len(r), rules[r] != "block", r))
    rule, verdict = none, none
    for r in reversed(order):
        r_host, slash, r_path = r.partition("/")
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(slash + r_path)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(rules[r])).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of a string's characters."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def term(c: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    return F.aggregate(F.transform(F.array_distinct(chars), term), F.lit(0.0), lambda a, x: a + x)


def _ratio(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def with_features(urls: DataFrame) -> DataFrame:
    """Lexical features and suffix keys from url, host and path."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    made = {
        "url_length": F.length(url), "host_length": F.length(host), "host_depth": F.size(labels),
        "path_length": F.length(path), "path_depth": F.size(segments),
        "digit_ratio": _ratio(url, "[^0-9]"), "host_digits": _ratio(host, "[^0-9]"),
        "hyphens": F.length(F.regexp_replace(url, "[^-_]", "")), "entropy": entropy(url),
        "path_entropy": entropy(path),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.length(query),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "longest_segment": F.coalesce(F.array_max(F.transform(segments, F.length)), F.lit(0)),
    }
    keys = {
        "top_label": F.element_at(labels, -1), "two_labels": F.array_join(F.slice(F.concat(F.array(F.lit("")), labels), -2, 2), "."),
        "extension": F.regexp_extract(path, r"\.([^./]*)$", 1), "first_segment": F.coalesce(F.get(segments, F.lit(0)), F.lit("")),
    }
    return urls.withColumns({k: v.cast("double") for k, v in made.items()} | keys)


def suffix_statistics(pages: DataFrame, training: DataFrame, key: str) -> DataFrame:
    """key, pages (all rows), n_labelled and n_blocked (training urls) of every suffix."""
    both = pages.select(key, F.lit(1).alias("page"), F.lit(None).cast("double").alias("label")).unionByName(
        training.select(key, F.lit(0).alias("page"), "label"))
    return both.groupBy(key).agg(F.sum("page").alias(f"{key}_pages"), F.count("label").alias(f"{key}_labelled"),
                                 F.coalesce(F.sum("label"), F.lit(0.0)).alias(f"{key}_blocked"))


def _with_statistics(rows: DataFrame, stats: list[DataFrame], n_pages: int, rate: float,
                     training: DataFrame | None = None) -> DataFrame:
    """Frequency and smoothed block rate of every suffix.  A training url's rates leave its whole fold out,
    so they say about it what they would say about an unlabelled url."""
    for key, table in zip(SUFFIXES, stats, strict=True):
        rows = rows.join(table, key, "left")
        labelled, blocked = F.coalesce(f"{key}_labelled", F.lit(0)), F.coalesce(f"{key}_blocked", F.lit(0.0))
        if training is not None:
            own = training.groupBy(key, "fold").agg(F.count("label").alias("own_n"), F.sum("label").alias("own_blocked"))
            rows = rows.join(own, [key, "fold"], "left")
            labelled, blocked = labelled - F.col("own_n"), blocked - F.col("own_blocked")
        rows = rows.withColumn(f"{key}_rate", (blocked + PRIOR_URLS * rate) / (labelled + PRIOR_URLS)).withColumn(
            f"{key}_share", F.log1p(F.coalesce(f"{key}_pages", F.lit(0)) / F.lit(max(n_pages, 1)) * 1e6)).drop(
            "own_n", "own_blocked")
    names = [*LEXICAL, *[f"{k}_{x}" for k in SUFFIXES for x in ("rate", "share")]]
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows)


def draw(labelled: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` distinct labelled urls, drawn by a hash of the url."""
    distinct = labelled.groupBy("url").agg(F.max("label").alias("label"))
    n = distinct.count()
    share = min(1.0, bound / max(n, 1))
    return distinct.where(F.pmod(F.xxhash64(F.lit("draw"), "url"), F.lit(1 << 20)) < int(share * (1 << 20)))


def judge(pages: DataFrame, rules: dict[str, str], labelled: DataFrame | None = None, page_id: str = "page_id",
          url: str = "url", max_training: int = MAX_TRAINING_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of blocking, by the trees) of every row.

    ``labelled``: url, label (1.0: block); by default the urls that rules decide."""
    rows = pick(pages, page_id=page_id, url=url)
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    if labelled is None:
        labelled = rows.where("ruled is not null").select("url", (F.col("ruled") == "block").cast("double").alias("label"))
    labelled = labelled.where("url is not null").withColumn("host", host_of(F.col("url"))).withColumn(
        "path", path_of(F.col("url")))
    training = materialize(draw(labelled.select("url", F.col("label").cast("double").alias("label")), max_training),
                           "training-urls")
    n, blocked = training.agg(F.count("label"), F.sum("label")).first()
    out = ["page_id", "host", "path", "rule"]
    if not n or blocked in (0, n):
        score = F.lit(1.0 if n and blocked == n else 0.0)
        return rows.select(*out, F.coalesce("ruled", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
                           score.alias("score"))
    training = with_features(training.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))))
    training = training.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)))
    pages_f = with_features(rows)
    stats = [materialize(suffix_statistics(pages_f, training, k), f"suffixes-{k}") for k in SUFFIXES]
    n_pages = rows.count()
    rate = blocked / n
    ready = materialize(_with_statistics(training, stats, n_pages, rate, training).select("url", "label", "features"), "url-features")
    # trees see rows in the same order whatever the partitions of the pages were
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=64).fit(
        ready.repartition(8, "url").sortWithinPartitions("url").select("label", "features"))
    scored = model.transform(_with_statistics(pages_f, stats, n_pages, rate))
    score = vector_to_array("probability")[1]
    return scored.select(*out, F.coalesce("ruled", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
                         score.alias("score"))
