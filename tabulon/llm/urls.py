"""URL filters: fixed rules, then association rules mined from labelled URLs.

A URL's host runs from the first ``://`` to the first ``/``, ``?``, ``#`` or the end (A-Z
in lower case), its path from there to ``?``, ``#`` or the end; without ``://`` both are
empty. A fixed rule fits its host and all subdomains where the path starts with the
rule's path; the longest one decides. Where none fits, mined rules do.

Mining: the tokens of a labelled URL (host labels and path words, with their hyphenated
parts; numbers are left out) and its label form one transaction; of tokens that always come
together only the first one does. Spark's FP-growth finds frequent combinations; a combination blocks if its confidence and its support are high
enough and no part of it blocks at least as surely. Mined rules match through an inverted
index: a rule is filed under its rarest token, so a URL meets only rules that share it,
and is then tested for the others.

Null URLs have empty host and path, fit no rule and are allowed. Equal URLs get equal
verdicts; repeated rows stay. Without labelled URLs nothing is mined and what no fixed
rule blocks is allowed. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.common import kept, small_or_plain

#: Host and path with their verdict; fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_CONFIDENCE = 0.8
#: A combination is frequent from this share of the labelled URLs, and from so many of them.
MIN_SUPPORT, MIN_URLS = 1e-3, 20
BLOCK, ALLOW = "=block", "=allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def fixed_rule(host_of: Column, path_of: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, means in sorted(rules, key=lambda r: len(r[0])):  # a longer one overrides
        rule_host, slash, rest = text.partition("/")
        fits = ((host_of == rule_host) | host_of.endswith(f".{rule_host}")) & path_of.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(means)).otherwise(verdict)
    return rule, verdict


def tokens(host_of: Column, path_of: Column) -> Column:
    """Sorted distinct tokens: h: and p: before labels and words, without numbers."""
    labels, segments = F.split(host_of, r"\."), F.split(path_of, r"[/.]+")
    parts = [_prefixed(labels, "h:"), _prefixed(segments, "p:")]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda w: ~w.rlike("^[hp]:[0-9]*$"))))


def _prefixed(words: Column, prefix: str) -> Column:
    every = F.concat(words, F.flatten(F.transform(words, lambda w: F.split(w, "[-_]+"))))
    return F.transform(every, lambda w: F.concat(F.lit(prefix), F.translate(w, UPPER, LOWER)))


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``sets`` (with an array ``tokens``) joined to every rule (rule, anchor)
    whose tokens they all hold, by the rules' anchor tokens."""
    index = small_or_plain(rules, 400)
    near = sets.withColumn("anchor", F.explode("tokens")).join(index, "anchor").drop("anchor")
    return near.where(F.size(F.array_except("rule", "tokens")) == 0)


def together(rows: DataFrame, least: float) -> DataFrame:
    """token and members: of the tokens in at least ``least`` rows (url, items), those that always
    come together, by the first of them. They are told by their number and two sums over hashes."""
    each = rows.select("url", F.explode("items").alias("token"))
    hashes = [F.bit_xor(F.xxhash64("url", F.lit(i))).alias(f"x{i}") for i in range(2)]
    of_token = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *hashes).where(F.col("n") >= least)
    groups = of_token.groupBy("n", "x0", "x1").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return groups.select(F.get("members", F.lit(0)).alias("token"), "members")


def closed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (url, items, mark) with one token of each group: k tokens that always come together
    would make 2 ** k equal combinations."""
    first = small_or_plain(groups.select("token"), 200)
    own = rows.select("url", F.explode("items").alias("token")).join(first, "token").groupBy("url").agg(F.collect_set("token").alias("own"))
    return rows.join(own, "url", "left").select("url", F.coalesce("own", F.array().cast("array<string>")).alias("items"), "mark")


def opened(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """The rules with each token in turn replaced by those that come with it."""
    each = rules.withColumn("token", F.explode("rule")).join(small_or_plain(groups, 400), "token")
    each = each.groupBy("rule", "confidence", "support").agg(F.collect_list("members").alias("choices"))

    def one_more(some, choice):
        return F.flatten(F.transform(some, lambda r: F.transform(choice, lambda t: F.concat(r, F.array(t)))))

    start = F.array(F.array().cast("array<string>"))
    every = F.explode(F.aggregate("choices", start, one_more))
    return each.select(every.alias("rule"), "confidence", "support").select(F.array_sort("rule").alias("rule"), "confidence", "support")


def anchored(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """The rules with their rarest token."""
    rarest = rules.withColumn("token", F.explode("rule")).join(frequency, "token").groupBy("rule", "confidence", "support").agg(
        F.min(F.struct("n", "token"))["token"].alias("anchor"))
    return rarest.select("rule", "anchor", "confidence", "support")


def mined_rules(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_support: float = MIN_SUPPORT,
                min_urls: int = MIN_URLS) -> DataFrame:
    """rule (sorted tokens), anchor, confidence and support of the blocking combinations of
    ``labelled`` (url, blocked)."""
    url = F.col("url")
    rows = labelled.where("url is not null and blocked is not null").groupBy("url").agg(F.max("blocked").alias("blocked"))
    mark = F.array(F.when(F.col("blocked"), BLOCK).otherwise(ALLOW)).alias("mark")
    rows = kept(rows.select("url", tokens(host(url), path(url)).alias("items"), mark))
    spark, count = labelled.sparkSession, rows.count()
    if count == 0:
        return spark.createDataFrame([], "rule array<string>, anchor string, confidence double, support double")
    support = min(1.0, max(min_support, min_urls / count))
    growth = FPGrowth(itemsCol="items", minConfidence=min_confidence, minSupport=support)
    groups = kept(together(rows, support * count))
    found = growth.fit(closed(rows, groups).select(F.concat("items", "mark").alias("items"))).associationRules
    blocking = kept(found.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(
        F.array_sort("antecedent").alias("rule"), "confidence", "support"))
    frequency = rows.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = kept(anchored(blocking, frequency))
    # a rule goes if a part of it blocks at least as surely
    wider = rarest.select(F.col("rule").alias("tokens"), F.col("rule").alias("of"), F.col("confidence").alias("own"))
    needless = matches(wider, rarest).where((F.size("rule") < F.size("of")) & (F.col("confidence") >= F.col("own")))
    left = rarest.join(needless.select(F.col("of").alias("rule")).distinct(), "rule", "left_anti")
    return kept(anchored(opened(left, groups), frequency))


def judged(df: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
           min_confidence: float = MIN_CONFIDENCE, min_support: float = MIN_SUPPORT, min_urls: int = MIN_URLS) -> DataFrame:
    """id, host, path, rule, verdict, and mined_rule (the surest mined rule that fits), of every row."""
    mined = mined_rules(labelled, min_confidence, min_support, min_urls)
    url = F.col("url")
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    pages = pages.withColumns({"host": F.coalesce(host(url), F.lit("")), "path": F.coalesce(path(url), F.lit(""))})
    urls = pages.select("url", tokens(F.col("host"), F.col("path")).alias("tokens"))
    best = F.max(F.struct("confidence", "support", "rule"))["rule"]
    hit = matches(urls, mined).groupBy("url").agg(best.alias("found"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    joined = pages.join(hit.withColumnRenamed("url", "hit_url"), F.col("url") == F.col("hit_url"), "left")
    joined = joined.withColumns({"rule": rule, "decided": verdict})
    return joined.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("decided", F.when(F.col("found").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.array_join("found", " ").alias("mined_rule"),
    )


def document_number(url: Column) -> Column:
    """The number that a URL's path ends in, with or without a suffix or a slash; else null."""
    number = F.regexp_extract(path(url), r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    return F.when(number != "", number).cast("long")


def labelled_by_document(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """url and blocked of the pages whose path ends in the number of a labelled document;
    a toxic document's URL counts as blocked."""
    numbered = pages.select(F.col(url_col).alias("url"), document_number(F.col(url_col)).alias("doc"))
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("blocked"))
    return numbered.join(marks, F.col("doc") == F.col("doc_id")).select("url", "blocked")
