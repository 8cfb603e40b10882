"""URL verdicts by rules and logistic regression on hashed n-grams (operator 5), with DataFrame functions alone.

A url is cut into host and path; a rule ``host/path`` fits its host and every
subdomain where the path begins with the rule's; of several the longest wins.
A url without a rule gets the verdict of a logistic regression over hashed
character 3- and 4-grams of ``^host$`` and of the path with its digits as 0,
fitted on a small labelled url table.  The weights, ``DIMENSIONS`` numbers,
are a constant of the plan: judging needs no shuffle and no join.

Defined results: a null url, or one without ``://``, has empty host and path
and no rule, and is judged by the regression like any other.  Equal urls get
equal verdicts; other columns are kept, added ones replace those of their name.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 1024
MAX_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The names of the labelled url table.
BLOCKED = """casino-win poker-room free-bets sports-betting online-slots lucky-jackpot adult-x xxx-videos porn-tube sex-cams
hot-dating cheap-pills buy-viagra weight-loss-pills pharma-discount payday-loans quick-cash crypto-doubler get-rich-fast
spam-farm link-farm seo-spam ads-track ad-server click-tracker popup-ads banner-exchange track-pixel free-download-crack
warez-keygen torrent-hub fake-watches replica-bags prize-winner gift-card-claim work-from-home-cash miracle-cure casino-bonus
bets-now pills-online""".split()
ALLOWED = """news-daily city-library river-museum garden-notes open-lectures math-archive physics-letters weather-center
cooking-book bread-recipes travel-journal mountain-hikes history-review language-school music-academy local-council
health-service science-today film-review book-corner photo-gallery code-handbook data-manual linux-guide astronomy-club
chess-club bird-watch train-times parliament university""".split()
# Most hosts are arbitrary names: pairs of common syllables stand for them.
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st le is ou ar".split()
ENDINGS = ["example.com", "example.org", "example.net", "test.org"]
FRONTS = ["", "www.", "blog.", "m."]
PATHS = ["/en/100", "/de/2000.html", "/fr/31/", "/es/40000", "/", "/index.html"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): every name under two hosts, endings, fronts and paths taken in turn."""
    rows = []
    arbitrary = [a + b + c for i, a in enumerate(SYLLABLES) for b in SYLLABLES[i % 3 :: 3] for c in (SYLLABLES[(i + 7) % 25],)]
    for label, names in ((1.0, BLOCKED), (0.0, ALLOWED + arbitrary)):
        for i, name in enumerate(names):
            for k in range(2):
                j = 2 * i + k
                rows.append((f"https://{FRONTS[j % 4]}{name}.{ENDINGS[(j // 2) % 4]}{PATHS[j % 6]}", label))
    return spark.createDataFrame(rows, "url string, label double")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the 3- and 4-grams of both parts."""

    def of(part: Column, salt: int, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(part) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(salt), F.substring(part, i, F.lit(n))), F.lit(DIMENSIONS)).cast("int"))

    host = F.concat(F.lit("^"), host, F.lit("$"))
    path = F.regexp_replace(path, "[0-9]+", "0")
    return F.array_distinct(F.concat(of(host, 3, 3), of(host, 4, 4), of(path, 5, 3)))


def fit(urls: DataFrame, url: str = "url", label: str = "label") -> list[float]:
    """Bias and weights of the logistic regression on a small labelled table."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    buckets = grams(host_of(F.col(url)), path_of(F.col(url)))
    rows = urls.select(F.col(label).cast("double").alias("label"), buckets.alias("b"))
    # one element per bucket, 1 / sqrt(number of buckets) where the url has it
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.when(F.array_contains("b", i), 1 / F.sqrt(F.size("b"))).otherwise(0.0))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1.0, n.get(0.0, 1) / n.get(1.0, 1)).otherwise(1.0)  # both classes weigh the same
    rows = rows.select("label", weight.alias("weight"), array_to_vector(dense).alias("features")).coalesce(1)
    model = LogisticRegression(regParam=0.0005, maxIter=60, standardization=False, weightCol="weight").fit(rows)
    return [float(model.intercept), *map(float, model.coefficients)]


def judge(df: DataFrame, weights: list[float], rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """All columns of ``df``, host, path, rule, score (of block) and verdict; rules are (``host/path``, verdict)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    table = [{"rule": r, "host": r.partition("/")[0], "path": "/" + r.partition("/")[2], "verdict": v} for r, v in sorted(rules, key=lambda x: (-len(x[0]), x[0]))]
    listed = F.from_json(F.lit(json.dumps(table)), "array<struct<rule:string,host:string,path:string,verdict:string>>")
    parts = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    host, path = F.col("host"), F.col("path")
    fits = lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])
    first = F.get(F.filter(listed, fits), 0)
    values = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    b = grams(host, path)
    z = F.element_at(values, 1) + F.aggregate(b, F.lit(0.0), lambda a, i: a + F.element_at(values, i + 2)) / F.sqrt(F.size(b))
    out = parts.withColumns({"_rule": first, "score": 1 / (1 + F.exp(-z))})
    out = out.withColumn("rule", F.col("_rule.rule"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("_rule")
