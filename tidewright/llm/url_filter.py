"""URL filters: listed rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small labelled URL table, whose hashed n-grams come from the same expressions
that judge the pages; judging is DataFrame expressions only, with no shuffle.

Defined results: a null URL, or one without "://", has an empty host and path; no rule fits it, and the model judges the
empty strings. Of rules of one length the first by verdict (allow before block) counts. Other columns pass through.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, table

BUCKETS, GRAMS = 32_768, (3, 4, 5)
#: Up to so many rules stand in the expression itself; more are joined. The labelled URLs are fitted on the driver.
INLINE_RULES, MOST_LABELLED = 200, 20_000

#: (host and path, verdict); the host ends at the first "/".
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: The small labelled URL table, by rule: words that hosts of each kind are made of, and paths below them.
TO_BLOCK = """
casino slots poker jackpot roulette betting bets gamble lottery pills viagra pharma cheap replica payday loans adult cams porn xxx
escort spam clickbait adserver tracker tracking popunder malware warez cracked torrents hacked phishing prize winner freebie
""".split()
TO_ALLOW = """
library museum garden recipes weather university hospital school church council history letters music physics textbook cycling
kitchen bakery river mountain village harbour theatre gallery journal archive research science travel hotel castle bridge forest
orchard winter summer teacher doctor engineer painter concert football tennis chess railway airport station market insurance
charity parish county region nature animals birds fishing sailing ocean island valley sunrise northern southern weaving pottery
""".split()


def _labelled() -> tuple[tuple[str, int], ...]:
    """Each word alone and joined to its neighbours in the list, under a few top domains and paths."""
    ends, paths = ("test", "org", "net", "info"), ("/", "/en/12", "/about", "/de/7/index.html", "/item?id=5")
    out = []
    for words, y in ((TO_BLOCK, 1), (TO_ALLOW, 0)):
        for k, w in enumerate(words):
            other, third = words[(k + 1) % len(words)], words[(k + 5) % len(words)]
            for j, name in enumerate((f"{w}-{other}", f"www.{w}{third}", f"{other}-{third}.{w}", f"blog.{w}")):
                out.append((f"http://{name}.{ends[(k + j) % 4]}{paths[(k + 2 * j) % 5]}", y))
    return tuple(out)


LABELLED = _labelled()


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct<size, verdict, rule> of the longest rule that fits, or null; each rule is tried."""
    parts = [(r, *r.partition("/")[::2], verdict) for r, verdict in rules]
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(h).alias("host"), F.lit(f"/{p}").alias("path"), F.lit(v).alias("verdict")) for r, h, p, v in parts])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    sized = F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("size"), r["verdict"].alias("verdict"), r["rule"].alias("rule")))
    return F.array_min(sized)


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, best (as of rule()) for the distinct host and path of urls that a rule fits. rules: rule, verdict.

    A URL meets the rules of each of its host's suffixes, by prefixes of its path as long as a rule of that host has;
    so it's joined with what fits it only, however many rules there are.
    """
    parts = F.split(F.col("rule"), "/", 2)
    listed = rules.select("rule", "verdict", parts[0].alias("on"), F.concat(F.lit("/"), F.get(parts, F.lit(1))).alias("start"))
    sizes = listed.groupBy("on").agg(F.collect_set(F.length("start")).alias("sizes"))  # at most as many as a path has characters
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = urls.select("host", "path").distinct().withColumn("on", F.explode(F.array_distinct(suffixes))).join(sizes, "on")
    each = each.select("host", "path", "on", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n")).withColumn("start", F.expr("substring(path, 1, n)"))
    sized = F.struct((-F.length("rule")).alias("size"), "verdict", "rule")
    return each.join(listed, ["on", "start"]).groupBy("host", "path").agg(F.min(sized).alias("best"))


def grams(host: Column, path: Column, sizes: tuple[int, ...] = GRAMS, buckets: int = BUCKETS) -> Column:
    """The buckets of all n-grams of "^host path$", repeated ones as often as they occur."""
    s = F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$"))

    def of_size(n: int) -> Column:  # the function of an element must have one parameter only; a second one is its position
        parts = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.pmod(F.xxhash64(F.substring(s, i, F.lit(n))), F.lit(buckets)).cast("int"))
        return F.when(F.length(s) >= n, parts).otherwise(F.array().cast("array<int>"))

    each = [of_size(n) for n in sizes]
    return F.concat(*each)


def fit(spark: SparkSession, labelled=LABELLED, buckets: int = BUCKETS, steps: int = 600, rate: float = 20.0, ridge: float = 1e-4, weight: float = 2.0) -> tuple[list[float], float]:
    """Weights by bucket, and the intercept: gradient descent on the mean log loss over n-gram counts by the root of their
    number, where a URL to block counts `weight` times."""
    if len(labelled) > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled URLs")
    if not labelled:
        return [0.0] * buckets, -1.0
    rows = F.from_json(F.lit(json.dumps([{"url": u, "y": y} for u, y in labelled])), "array<struct<url: string, y: int>>")
    urls = spark.range(1).select(F.inline(rows))
    told = urls.select(grams(host(F.col("url")), path(F.col("url")), buckets=buckets).alias("g"), "y").collect()
    y = np.array([r["y"] for r in told], float)
    of = np.repeat(np.arange(len(told)), [len(r["g"]) for r in told])
    at = np.array([k for r in told for k in r["g"]], int)
    part = 1 / np.sqrt(np.maximum(np.bincount(of, minlength=len(told)), 1))[of]
    share = np.where(y > 0, weight, 1.0)
    share /= share.sum()
    weights, bias = np.zeros(buckets), 0.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(bias + np.bincount(of, part * weights[at], len(told))))) - y) * share
        bias -= rate * error.sum()
        weights -= rate * (np.bincount(at, part * error[of], buckets) + ridge * weights)
    return weights.tolist(), float(bias)


def judged(pages: DataFrame, url: str = "url", rules=RULES, labelled=LABELLED) -> DataFrame:
    """pages with host, path, rule, verdict and score, the model's probability that the page is to be blocked. Columns of
    these names are replaced, the URL column itself as well. rules: pairs, or a frame with rule and verdict."""
    spark = pages.sparkSession
    weights, bias = fit(spark, labelled)
    at = fresh(pages, "found")
    h, p = host(F.col(url)), path(F.col(url))
    out = pages.withColumn(at, F.struct(h.alias("host"), p.alias("path")))
    if not isinstance(rules, DataFrame) and len(rules) > INLINE_RULES:
        rules = spark.createDataFrame(list(rules), "rule string, verdict string")
    if isinstance(rules, DataFrame):
        best = ruled(out.select(f"{at}.*"), rules).select(F.col("host").alias(f"{at}h"), F.col("path").alias(f"{at}p"), F.col("best").alias(f"{at}b"))
        out = out.join(best, (F.col(f"{at}.host") == F.col(f"{at}h")) & (F.col(f"{at}.path") == F.col(f"{at}p")), "left").withColumnRenamed(f"{at}b", f"{at}best").drop(f"{at}h", f"{at}p")
    else:
        out = out.withColumn(f"{at}best", rule(F.col(f"{at}.host"), F.col(f"{at}.path"), rules) if rules else F.lit(None).cast("struct<size:int,verdict:string,rule:string>"))
    table_ = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # one constant, not one for each weight
    g = grams(F.col(f"{at}.host"), F.col(f"{at}.path"))
    z = bias + F.aggregate(g, F.lit(0.0), lambda s, k: s + F.get(table_, k)) / F.sqrt(F.greatest(F.size(g), F.lit(1)))
    out = out.withColumns({"score": 1 / (1 + F.exp(-z)), "host": F.col(f"{at}.host"), "path": F.col(f"{at}.path"), "rule": F.col(f"{at}best.rule")})
    return out.withColumn("verdict", F.coalesce(F.col(f"{at}best.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))).drop(at, f"{at}best")


def query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
