"""URL filters by association rules.

Urls become sets of tokens: labels of the host, segments of the path, keys of the query. FP-growth mines the combinations that stand
together with the label ``block`` in a labelled table; those of enough support and confidence, without the ones that a shorter rule makes
needless, become rules. An index from a rule's rarest token to the rule finds candidates; a rule fires where
all its tokens are in the url. Fixed rules of hosts and paths come first. Tokens that never part, as the keys of a search or of a tracker, are mined as one.

Defined results: a NULL url, or one without ``://``, has an empty host and path and no tokens, matches no rule and is allowed; without labelled rows, or if no
rule is good enough, nothing is blocked but by fixed rules; very long urls are read whole; of several rules that fit the surest counts, of equally sure ones it makes no
difference; repeated rows each get a verdict. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import LOWER, UPPER, stored

#: Rows with the block mark that make a combination of tokens a candidate, whatever the size of the table.
LEAST_ROWS = 5
BLOCK, ALLOW = "block", "allow"
MARK = "=block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct ``h:`` labels of the host, ``p:`` segments of the path, ``q:`` keys of the query."""
    mark = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    all_ = F.concat(mark("h:", F.split(host_of(url), r"\.")), mark("p:", F.split(path_of(url), "/")), mark("q:", keys))
    return F.array_sort(F.array_distinct(all_))


def mine(labelled: DataFrame, support: float | None = None, confidence: float = 0.5, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Rules (rule_id, tokens, any, confidence, support, rarest) from all rows of ``labelled`` (url, blocked boolean, key).

    A rule's tokens stand together with the block mark in ``least_rows`` rows, or in the share ``support`` of the rows if that is given. Rules that
    a shorter one makes needless go, so of the many combinations of a host that is always blocked few stay.

    Tokens that stand in the same rows are mined as one, named by the first of them, and so are no combinations of their own: a rule fires where for each of its ``tokens`` one
    of those that it stands for (``any``) is in the url. A token that is blocked each time is a rule that no longer one betters, and takes no part in combinations.
    """
    rows = labelled.filter("url is not null and blocked is not null and key is not null")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("r"), "blocked", tokens_of(F.col("url")).alias("items")))
    n = rows.count()
    least = least_rows if support is None else max(1, math.ceil(support * n))
    each = rows.select("r", "blocked", F.explode("items").alias("name"))
    tokens = each.groupBy("name").agg(F.count("*").alias("freq"), F.count_if("blocked").alias("marked"), F.bit_xor(F.xxhash64("r")).alias("x"), F.bit_xor(F.xxhash64("r", F.lit(1))).alias("y"))
    alike = tokens.filter(F.col("marked") >= least).groupBy("freq", "marked", "x", "y").agg(F.sort_array(F.collect_list("name")).alias("any"))
    classes = stored(alike.select(F.col("any")[0].alias("name"), "any", "freq", "marked"))
    levels = [stored(classes.select(F.array("name").alias("tokens"), (F.col("marked") / F.col("freq")).alias("confidence"), "marked", F.lit(0.0).alias("best")))]

    # FP-growth keeps the frequent tokens in the driver itself, so they may go out whole.
    open_ = classes.filter("marked < freq").select("name")
    kept = stored(each.join(F.broadcast(open_), "name").groupBy("r", "blocked").agg(F.collect_list("name").alias("names")))
    transactions = kept.select(F.concat("names", F.when(F.col("blocked"), F.array(F.lit(MARK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    many = kept.count()
    if many:
        # Half a row less, so that the share times the rows, rounded up again, is the count.
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / many)).fit(transactions)
        sets = stored(model.freqItemsets.select(F.array_sort(F.array_remove("items", MARK)).alias("tokens"), F.array_contains("items", MARK).alias("mark"), "freq").filter(F.size("tokens") > 1))
        marked = sets.filter("mark").select("tokens", F.col("freq").alias("marked"))
        sets = stored(marked.join(sets.filter("not mark").select("tokens", "freq"), "tokens").withColumn("confidence", F.col("marked") / F.col("freq")))
        for k in range(2, (sets.agg(F.max(F.size("tokens"))).first()[0] or 1) + 1):
            # Every part of a frequent set is one, so the surest part is found a level at a time.
            parts = sets.filter(F.size("tokens") == k).withColumn("token", F.explode("tokens")).withColumn("part", F.array_remove("tokens", F.col("token")))
            before = levels[-1].select(F.col("tokens").alias("part"), F.greatest("confidence", "best").alias("b"))
            levels.append(stored(parts.join(before, "part").groupBy("tokens", "confidence", "marked").agg(F.max("b").alias("best"))))
    rules = levels[0]
    for level in levels[1:]:
        rules = rules.unionByName(level)
    rules = rules.filter((F.col("confidence") >= confidence) & (F.col("best") < F.col("confidence"))).withColumn("rule_id", F.xxhash64("tokens"))
    of = rules.select("rule_id", "tokens", "confidence", "marked", F.explode("tokens").alias("name")).join(classes.select("name", "any", "freq"), "name")
    found = of.groupBy("rule_id", "tokens", "confidence", "marked").agg(F.min(F.struct("freq", "name", "any")).alias("r"), F.collect_list("any").alias("any"))
    return found.select("rule_id", "tokens", "any", "confidence", (F.col("marked") / max(1, n)).alias("support"), F.col("r.any").alias("rarest"))


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence): urls of ``urls`` (distinct) that a rule fits, with the surest one. A rule is met through each token that its rarest one stands for."""
    index = rules.select("any", "confidence", F.explode("rarest").alias("token"))
    met = urls.select("url", tokens_of(F.col("url")).alias("all")).select("url", "all", F.explode("all").alias("token")).join(index, "token")
    return met.filter(F.forall("any", lambda a: F.arrays_overlap(a, F.col("all")))).groupBy("url").agg(F.max("confidence").alias("confidence"))


def fixed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits, or NULL. A rule fits its host and subdomains, and paths that start with its own."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], **limits) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of each row of ``pages`` (page_id, url).

    ``labels`` (page_id, blocked): what to learn from. ``rules``: fixed ones, that win.
    """
    pages = pages.select("page_id", "url")
    known = labels.filter("page_id is not null").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    mined = stored(mine(pages.join(known, "page_id").select("url", "blocked", F.col("page_id").alias("key")), **limits))
    sure = fired(pages.select("url").filter("url is not null").distinct(), mined)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    # Rows without a url are met by no rule and are not dealt by their one key.
    out = pages.filter("url is not null").join(sure, "url", "left").unionByName(pages.filter("url is null").withColumn("confidence", F.lit(None).cast("double")))
    out = out.select("page_id", host.alias("host"), path.alias("path"), "confidence")
    out = out.withColumn("f", fixed(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("f.verdict", F.when(F.col("confidence").isNotNull(), BLOCK).otherwise(ALLOW))
    return out.select("page_id", "host", "path", F.col("f.rule").alias("rule"), verdict.alias("verdict"), "confidence")
