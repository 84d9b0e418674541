"""URL filters: rules first, then gradient-boosted trees on lexical features; DataFrame functions only.

Rules name a host (with all its subdomains) and a path prefix; the longest rule
that fits decides.  Urls that no rule fits are judged by boosted trees learned
from those that rules label: a level of a tree is one aggregation to
(node, feature, bin) sums of gradients, whose size is fixed, and the finished
trees are one SQL expression.

Suffix statistics say how often urls with the same host suffix are blocked: of
the last label, of the last two, and of the last label with the first directory
of the path.  They come from all labelled rows by partial aggregation; for a
row that trains the trees its own fold is left out, so that no row is judged by
its own label.  A suffix without labelled rows has the overall share.  Trees are fitted on at most about ``sample_rows`` labelled
rows, chosen by a hash of id and url; all rows are judged.

Null urls and those without ``://`` have an empty host and path and fit no
rule.  Repeated urls and ids are judged each on their own.  With no labelled
urls of either kind the verdict is the prior (allow).  Empty tables give empty
results; columns besides the id and the url are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import LOWER, UPPER
from .store import keep

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
FEATURES = ("url_length", "path_length", "depth", "digit_ratio", "entropy", "params", "host_labels", "host_hyphens", "label_block", "domain_block", "directory_block")
#: What suffix statistics are kept for.
SUFFIXES = ("label", "domain", "directory")


@dataclass(frozen=True)
class Boosting:
    trees: int = 10
    depth: int = 3
    bins: int = 16
    rate: float = 0.3
    l2: float = 1.0
    sample_rows: int = 20_000
    folds: int = 5
    #: Rows of the overall share that a suffix's statistics are smoothed with.
    smooth: float = 10.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    pattern = "://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null."""
    name = verdict = F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, below = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + below))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _entropy(s: Column) -> Column:
    n = F.length(s)
    total = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise((n - F.length(F.replace(s, c, F.lit("")))) * F.log2((n - F.length(F.replace(s, c, F.lit("")))).cast("double"))))
    return F.when(n == 0, 0.0).otherwise(F.log2(n.cast("double")) - total / n)


def _count(s: Column, what: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(what), F.lit("")))).cast("double")


def url_features(rows: DataFrame) -> DataFrame:
    """Adds the lexical features to (url, host, path), and the suffixes that have statistics."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    return rows.select(
        "*",
        F.substring_index("host", ".", -1).alias("label"),
        F.substring_index("host", ".", -2).alias("domain"),
        F.concat(F.substring_index("host", ".", -1), F.lit("/"), F.regexp_extract("path", "^/([^/]*)", 1)).alias("directory"),
        F.length(url).cast("double").alias("url_length"),
        F.length("path").cast("double").alias("path_length"),
        _count(F.col("path"), "/").alias("depth"),
        F.when(F.length(url) == 0, 0.0).otherwise(F.length(F.regexp_replace(url, "[^0-9]", "")) / F.length(url)).alias("digit_ratio"),
        _entropy(url).alias("entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1).alias("params"),
        F.when(F.col("host") == "", 0.0).otherwise(_count(F.col("host"), ".") + 1).alias("host_labels"),
        _count(F.col("host"), "-").alias("host_hyphens"),
    )


def _bin(feature: str, cuts: list[float]) -> Column:
    out = F.lit(0)
    for k, cut in enumerate(cuts):
        out = F.when(F.col(feature) > cut, k + 1).otherwise(out)
    return out


def fit(sample: DataFrame, how: Boosting) -> tuple[Column, float]:
    """The margin of ``block`` as an expression over the features, and its constant part; ``sample`` has them and y (0 or 1)."""
    total = sample.agg(F.count(F.lit(1)), F.sum("y"), *(F.percentile_approx(f, [k / how.bins for k in range(how.bins + 1)], 10_000) for f in FEATURES)).first()
    n, ones = total[0], total[1] or 0
    base = math.log((ones + 0.5) / (n - ones + 1.5))  # without labels slightly towards allow
    margin = F.lit(base)
    # halfway between quantiles, so that a value that no labelled row has goes to the nearer side
    cuts = {}
    for i, f in enumerate(FEATURES):
        values = sorted(set(total[2 + i] or []))
        cuts[f] = [(a + b) / 2 for a, b in zip(values[:-1], values[1:], strict=True)]
    if not 0 < ones < n:
        return margin, base
    # a row's bins once, so that each level only sums
    binned = keep(sample.select("y", *FEATURES, F.array(*(F.struct(F.lit(i).alias("f"), _bin(f, cuts[f]).alias("b")) for i, f in enumerate(FEATURES))).alias("bins")), "url-bins")
    for _ in range(how.trees):
        p = 1 / (1 + F.exp(-margin))
        rows = binned.select(*FEATURES, "bins", (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"))
        split: dict[int, tuple[str, float]] = {}
        leaves: dict[int, float] = {}
        node = F.lit(1)
        open_nodes = {1}
        for _ in range(how.depth):
            sums = rows.select(node.alias("node"), "g", "h", F.explode("bins").alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # at most nodes x features x bins
            found: dict[int, tuple[str, float]] = {}
            for at in open_nodes:
                own = [r for r in sums if r["node"] == at]
                g, h = (sum(r[k] for r in own if r["f"] == 0) for k in ("g", "h"))
                best = 1e-6
                for i, f in enumerate(FEATURES):
                    left_g = left_h = 0.0
                    by = {r["b"]: r for r in own if r["f"] == i}
                    for b, cut in enumerate(cuts[f]):
                        if b in by:
                            left_g, left_h = left_g + by[b]["g"], left_h + by[b]["h"]
                        gain = left_g**2 / (left_h + how.l2) + (g - left_g) ** 2 / (h - left_h + how.l2) - g**2 / (h + how.l2)
                        if gain > best + 1e-9 and left_h > 1e-9 and h - left_h > 1e-9:
                            best, found[at] = gain, (f, cut)
                leaves[at] = -how.rate * g / (h + how.l2)
                if at in found:
                    f, cut = found[at]
                    below = [r for r in own if r["f"] == FEATURES.index(f) and r["b"] <= cuts[f].index(cut)]
                    lg, lh = sum(r["g"] for r in below), sum(r["h"] for r in below)
                    leaves[2 * at], leaves[2 * at + 1] = -how.rate * lg / (lh + how.l2), -how.rate * (g - lg) / (h - lh + how.l2)
            if not found:
                break
            split |= found
            step = node
            for at, (f, cut) in found.items():
                step = F.when(node == at, F.when(F.col(f) > cut, 2 * at + 1).otherwise(2 * at)).otherwise(step)
            node = step
            open_nodes = {2 * at + k for at in found for k in (0, 1)}

        def value(at: int) -> Column:
            if at not in split:
                return F.lit(leaves[at])
            f, cut = split[at]
            return F.when(F.col(f) > cut, value(2 * at + 1)).otherwise(value(2 * at))

        margin = margin + value(1)
    return margin, base


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(kind, suffix, fold, n, blocked) of rows with the suffixes, fold and y."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in SUFFIXES)))
    return labelled.select("fold", "y", kinds.alias("x")).groupBy("x.kind", "x.suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("blocked"))


def with_statistics(rows: DataFrame, counts: DataFrame, how: Boosting, prior: float, *, own_fold: bool) -> DataFrame:
    """Adds the suffix statistics; without ``own_fold`` the rows' own fold does not count."""
    for kind in SUFFIXES:
        mine = counts.filter(F.col("kind") == kind)
        whole = mine.groupBy(F.col("suffix").alias(kind)).agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
        rows = rows.join(whole, kind, "left")
        many, bad = F.coalesce("all_n", F.lit(0)), F.coalesce("all_blocked", F.lit(0.0))
        if not own_fold:
            rows = rows.join(mine.select(F.col("suffix").alias(kind), "fold", F.col("n").alias("own_n"), F.col("blocked").alias("own_blocked")), [kind, "fold"], "left")
            many, bad = many - F.coalesce("own_n", F.lit(0)), bad - F.coalesce("own_blocked", F.lit(0.0))
        share = (bad + how.smooth * prior) / (many + how.smooth)
        rows = rows.withColumn(f"{kind}_block", share).drop("all_n", "all_blocked", "own_n", "own_blocked")
    return rows


def learn(labelled: DataFrame, how: Boosting = Boosting()) -> tuple[Column, DataFrame, float]:
    """The margin of ``block`` over the features, the suffix counts and the labelled rows' share of blocks; rows as of ``url_features``, with y and pick."""
    labelled = labelled.withColumn("fold", F.pmod(F.shiftright("pick", 32), F.lit(how.folds)).cast("int"))
    counts = keep(suffix_counts(labelled), "url-suffixes")
    n, blocked = counts.filter(F.col("kind") == SUFFIXES[0]).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    prior = (blocked + 0.5) / (n + 1.0)
    sample = labelled
    if n > how.sample_rows:
        sample = sample.filter(F.pmod("pick", F.lit(1_000_000)) < int(1e6 * how.sample_rows / n))
    sample = with_statistics(sample, counts, how, prior, own_fold=False)
    margin, _ = fit(keep(sample.select(*FEATURES, "y").coalesce(8), "url-sample"), how)
    return margin, counts, prior


def url_filter(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, how: Boosting = Boosting()) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score (the trees' probability of block)."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = url_features(rows.select("*", name.alias("rule"), verdict.alias("said")))
    labelled = rows.filter("said is not null").withColumns({"y": F.when(F.col("said") == "block", 1.0).otherwise(0.0), "pick": F.xxhash64("page_id", "url")})
    margin, counts, prior = learn(labelled, how)
    rows = with_statistics(rows, counts, how, prior, own_fold=True)
    score = 1 / (1 + F.exp(-margin))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("block_score"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
