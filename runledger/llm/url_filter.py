"""URL filtering by association rules.

Listed rules decide the urls they fit. The verdicts of those urls are the
labels from which FP-growth mines combinations of url tokens; rules whose
consequent is a label, pruned by support and confidence, decide the others
through an inverted index from token to rule.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.plans.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
#: A mined rule holds for at least this share of the labelled urls...
MIN_SUPPORT = 0.02
#: ... and this share of the labelled urls with its tokens has its verdict.
MIN_CONFIDENCE = 0.8
#: What stands between an item and the kind of basket it is in.
MARK, DOMAIN = "\x1e", "domain"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule of (verdict, host, path), as struct(rule, verdict); null if none fits.

    A list of rules is written by hand, so it is an expression of the plan.
    """
    fitted = F.lit(None)
    ranked = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0]))
    for verdict, of_host, of_path in ranked:
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        fitted = F.when(fits, F.struct(F.lit(of_host + of_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitted)
    return fitted


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: each domain a host is in, its labels, path segments, and query keys.

    Tokens say where they stand, so `fr` in a path is not `fr` in a host.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    mark = lambda column, kind: F.transform(column, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(mark(F.filter(suffixes, lambda x: x != ""), "domain:"), mark(labels, "label:"), mark(segments, "path:"), mark(keys, "key:")))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, verdict, hits, total) mined from (tokens, verdict).

    A rule that no more than repeats a part of itself (fewer tokens, at least
    the confidence) is pruned. Such are all rules with a token that another of
    theirs implies, so those are not mined in the first place: tokens that
    always come together are one item, and a domain meets neither the domains
    it is in nor its own labels. Empty input gives no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.select("tokens", F.concat(F.lit("verdict:"), F.col("verdict")).alias("label"), F.sha2(F.to_json(F.array_sort("tokens")), 256).alias("basket"))
    least = math.ceil(min_support * rows.count())
    members = cut(_together(rows, least))
    baskets = cut(_baskets(rows, members))
    # The support is one of urls, of which each is in several baskets.
    share = max(0.0, (least - 0.5) / max(1, baskets.count()))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence, numPartitions=partitions).fit(baskets)
    # Items of a basket for a domain are marked with its length; without the domain they say nothing new.
    found = model.freqItemsets.select("freq", F.transform("items", lambda x: F.substring_index(x, MARK, 1)).alias("level"), F.transform("items", lambda x: F.substr(x, F.instr(x, MARK) + 1)).alias("items"), F.exists("items", lambda x: x.startswith(DOMAIN + MARK)).alias("of_domain"))
    found = found.where("of_domain or forall(level, x -> x = '0' or x = 'verdict')")
    sets = cut(found.select(F.array_sort("items").alias("items"), "freq").dropDuplicates(["items"]))
    is_label = lambda x: x.startswith("verdict:")
    heads = sets.where(F.exists("items", is_label) & (F.size("items") > 1)).select(
        F.filter("items", lambda x: ~x.startswith("verdict:")).alias("tokens"), F.substring_index(F.filter("items", is_label)[0], ":", -1).alias("verdict"), F.col("freq").alias("hits")
    )
    bodies = sets.where(~F.exists("items", is_label)).select(F.col("items").alias("tokens"), F.col("freq").alias("total"))
    rules = cut(heads.where(F.size("tokens") > 0).join(bodies, "tokens").where(F.col("hits") >= F.col("total") * min_confidence))
    # Each rule meets its own parts of one token fewer, by equality.
    parts = rules.select("*", F.explode(F.col("tokens")).alias("left_out")).select(F.array_remove("tokens", F.col("left_out")).alias("part"), "tokens", "verdict", "hits", "total")
    shorter = rules.select(F.col("tokens").alias("part"), "verdict", F.col("hits").alias("p_hits"), F.col("total").alias("p_total"))
    redundant = parts.join(shorter, ["part", "verdict"]).where(F.col("p_hits") * F.col("total") >= F.col("hits") * F.col("p_total")).select("tokens", "verdict").distinct()
    kept = rules.join(redundant, ["tokens", "verdict"], "left_anti")
    return cut(_spelled_out(kept, members).select(F.sha2(F.concat_ws("\x1f", "verdict", "tokens"), 256).alias("rule_id"), "tokens", "verdict", "hits", "total"))


def _together(rows: DataFrame, least: int) -> DataFrame:
    """(token, item) of the tokens of at least `least` urls; tokens of just the same urls have one item."""
    sums = [F.sum(F.xxhash64("basket", F.lit(seed)).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
    seen = rows.select("basket", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= least)
    same = Window.partitionBy("n", "s1", "s2")
    return seen.select("token", F.min("token").over(same).alias("item"))


def _baskets(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(items) to mine: for each url one of all items but domains, and one for each of its domains.

    A domain's basket holds it and what it does not imply. Distinct sets of
    tokens are looked up once.
    """
    distinct = rows.groupBy("basket").agg(F.first("tokens").alias("tokens"))
    token = distinct.select("basket", F.explode("tokens").alias("token")).join(members, "token")
    known = token.groupBy("basket").agg(F.collect_list(F.struct("token", "item")).alias("known"))
    plain = F.filter("known", lambda x: ~x["token"].startswith("domain:"))
    domains = F.filter("known", lambda x: x["token"].startswith("domain:"))

    def of_domain(d: Column) -> Column:
        labels = F.split(F.substr(d["token"], F.lit(8)), r"\.")
        implied = F.transform(labels, lambda x: F.concat(F.lit("label:"), x))
        others = F.transform(F.filter(plain, lambda x: ~F.array_contains(implied, x["token"]) & (x["item"] != d["item"])), lambda x: F.concat(F.size(labels).cast("string"), F.lit(MARK), x["item"]))
        return F.array_append(others, F.concat(F.lit(DOMAIN + MARK), d["item"]))

    without = F.transform(plain, lambda x: F.concat(F.lit("0" + MARK), x["item"]))
    # A domain that always comes with a label is mined as that label, one that always comes with a longer one as that.
    named = F.transform(plain, lambda x: x["item"])
    longer = lambda d: F.exists(domains, lambda e: (e["item"] == d["item"]) & (F.length(e["token"]) > F.length(d["token"])))
    alone = F.filter(domains, lambda d: ~F.array_contains(named, d["item"]) & ~longer(d))
    every = F.concat(F.array(without), F.transform(alone, of_domain))
    sets = known.select("basket", F.transform(every, lambda x: F.array_distinct(x)).alias("sets"))
    return rows.join(sets, "basket").select("label", F.explode("sets").alias("items")).select(F.array_append("items", F.concat(F.lit("verdict" + MARK), F.col("label"))).alias("items"))


def _spelled_out(rules: DataFrame, members: DataFrame) -> DataFrame:
    """Rules of items as rules of tokens: one for each way to choose a token of each item."""
    names = members.groupBy("item").agg(F.array_sort(F.collect_list("token")).alias("names"))
    item = rules.select("*", F.col("tokens").alias("rule"), F.explode("tokens").alias("item")).join(names, "item")
    choices = item.groupBy("rule", "verdict", "hits", "total").agg(F.collect_list("names").alias("choices"))
    none = F.array(F.array().cast("array<string>"))
    ways = F.aggregate("choices", none, lambda done, names: F.flatten(F.transform(done, lambda d: F.transform(names, lambda n: F.array_append(d, n)))))
    return choices.select(F.explode(ways).alias("way"), "verdict", "hits", "total").select(F.array_sort("way").alias("tokens"), "verdict", "hits", "total")


def apply_rules(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, mined_verdict, mined_rule) of the urls (key, tokens) that a rule matches.

    The index maps a token to the rules that need it; a rule matches where as
    many of its tokens meet as it has. Of several, the most confident decides,
    then the better supported, then block over allow.
    """
    index = rules.select("rule_id", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    met = urls.select(key, F.explode("tokens").alias("token")).join(index, "token").groupBy(key, "rule_id").agg(F.count(F.lit(1)).alias("met"), F.first("need").alias("need")).where("met = need")
    rank = F.struct((F.col("hits") / F.col("total")).alias("c"), F.col("hits").alias("h"), F.col("verdict").alias("v"), F.col("rule_id").alias("r"))
    best = met.join(rules, "rule_id").groupBy(key).agg(F.max_by(F.struct("verdict", "tokens"), rank).alias("best"))
    return best.select(key, F.col("best.verdict").alias("mined_verdict"), F.array_join("best.tokens", " ").alias("mined_rule"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = ALLOW, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per input row: key, host, path, rule, verdict, mined_rule.

    A null url, or one without `://`, has an empty host and path and no tokens:
    no rule fits it and it gets `default`, as does a url no mined rule matches
    and every url when nothing is labelled. Repeated rows and null keys are
    judged each by its url. Other columns are not read.
    """
    base = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(url).alias("url"))
    fitted = base.withColumn("fit", listed_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(F.col("host"), F.col("path"), F.col("url")))
    judged = cut(fitted.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("listed"), "tokens"))
    labelled = judged.where("listed is not null").select("tokens", F.col("listed").alias("verdict"))
    mined = mine_rules(labelled, min_support, min_confidence)
    # Urls of equal tokens are judged once; the rest of the corpus is not shuffled for them.
    open_urls = judged.where("listed is null and size(tokens) > 0").select(F.sha2(F.array_join("tokens", "\x1f"), 256).alias("u"), "tokens").dropDuplicates(["u"])
    verdicts = apply_rules(open_urls, mined, "u")
    # Rows that a listed rule decides find nothing, each under a name of its own so that they do not meet in one task.
    u = F.when(F.col("listed").isNull() & (F.size("tokens") > 0), F.sha2(F.array_join("tokens", "\x1f"), 256)).otherwise(F.concat(F.lit("row:"), F.xxhash64("page_id", "path").cast("string")))
    return judged.withColumn("u", u).join(verdicts, "u", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("listed", "mined_verdict", F.lit(default)).alias("verdict"), "mined_rule"
    )
