"""URL filtering: explicit host and path rules first, then mined association rules; DataFrame operations only.

A URL is a transaction of tokens (domain suffixes, path words, query keys, scheme). FP-growth over
labelled URLs finds token combinations; those that imply a label with enough support, confidence and lift become
rules. Rules match through an inverted index: each rule is posted only under that of its tokens which the fewest URLs
have, a URL looks up its own tokens, and what it finds is checked against the rule's remaining tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriscope.llm._shared import Scratch, ascii_lower, join_unique


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, else null, as without rules. rules: (`host/path`, verdict)."""
    fits = [F.lit(None).cast("struct<rule: string, verdict: string>")]
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens with a prefix that tells their place; an empty array for a null URL."""
    tagged = lambda tag, words: F.transform(words, lambda w: F.concat(F.lit(tag), w))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels))), lambda n: F.concat(F.lit("d:"), F.concat_ws(".", F.slice(labels, n, F.size(labels)))))
    words = F.split(ascii_lower(path), "[^a-z0-9]+")
    keys = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1))
    scheme = F.array(F.concat(F.lit("s:"), ascii_lower(F.substring_index(url, "://", 1))))
    all_tokens = F.concat(scheme, suffixes, tagged("p:", words), tagged("q:", keys))
    kept = F.array_distinct(F.filter(all_tokens, lambda t: F.length(t) > 2))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.coalesce(kept, F.array().cast("array<string>")))


def rule_name(tokens: Column) -> Column:
    """Sorted tokens joined by spaces. Spaces and backslashes within a token get a backslash, so that two
    combinations never share a name."""
    return F.array_join(F.transform(tokens, lambda t: F.regexp_replace(t, r"[\\ ]", r"\\$0")), " ")


def mine_rules(labelled: DataFrame, min_support: float, min_rows: int, min_confidence: float, min_lift: float, partitions: int | None = None) -> DataFrame:
    """rule_id, tokens, label, confidence, support from labelled(tokens, label).

    A combination must hold in min_support of the rows and in min_rows of them, so that
    few labelled rows give few rules; no labelled rows give none. Tokens that all rows have are left out: they add
    nothing to a combination.
    """
    spark = labelled.sparkSession
    schema = "rule_id string, tokens array<string>, label string, confidence double, lift double, support double"
    labelled = labelled.filter(F.size("tokens") > 0)
    rows = labelled.count()
    if rows < min_rows:
        return spark.createDataFrame([], schema)
    always = [r[0] for r in labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") == rows).collect()]  # no more than one row has
    tokens = F.array_except("tokens", F.array(*map(F.lit, always)).cast("array<string>"))
    baskets = labelled.select(F.concat(tokens, F.array(F.concat(F.lit("label="), "label"))).alias("items"))
    min_support = max(min_support, min_rows / rows)
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, **{"numPartitions": partitions} if partitions else {}).fit(baskets).associationRules
    implied = F.element_at("consequent", 1)
    rules = rules.filter(implied.startswith("label=") & (F.col("lift") >= min_lift) & ~F.exists("antecedent", lambda t: t.startswith("label=")))
    tokens = F.array_sort("antecedent")
    return rules.select(rule_name(tokens).alias("rule_id"), tokens.alias("tokens"), F.substring(implied, 7, 1 << 20).alias("label"), "confidence", "lift", "support")


def prune_rules(rules: DataFrame) -> DataFrame:
    """Without the rules to which a rule of one token less gives the same label with at least the same confidence; the
    shorter ones are looked up by key, not compared pairwise."""
    shorter = rules.select("rule_id", "label", "confidence", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens"))).alias("out"))
    shorter = shorter.filter(F.size("tokens") > 1).select("rule_id", "label", "confidence", rule_name(F.filter("tokens", lambda t, i: i != F.col("out") - 1)).alias("part"))
    parts = rules.select(F.col("rule_id").alias("part"), "label", F.col("confidence").alias("part_confidence"))
    needless = shorter.join(parts, ["part", "label"]).filter(F.col("part_confidence") >= F.col("confidence")).select("rule_id", "label").distinct()
    return rules.join(needless, ["rule_id", "label"], "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """key, label of the best rule of each row of urls(key, tokens) that any rule matches.

    Best: highest confidence, then support, then fewest tokens, then rule_id and label.
    """
    scratch = Scratch(urls.sparkSession, "match-rules")
    each = rules.select("*", F.explode("tokens").alias("token"))
    words = urls.select("key", "tokens", F.explode("tokens").alias("token"))
    # Rules' tokens are frequent in the labelled URLs, so that their number is bounded by 1 / min_support times the tokens
    # of a URL.
    common = words.join(F.broadcast(each.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("urls"))
    common = scratch.table(common, "common")
    # Tokens that no URL has find nothing, and neither do their rules.
    held = each.join(common, "token", "left").groupBy("rule_id", "label").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("rarest"), F.first("tokens").alias("rule_tokens"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    posts = held.filter("rarest.urls > 0").select(F.col("rarest.token").alias("token"), F.struct("rule_id", "label", "rule_tokens", "confidence", "support").alias("rule"))
    posts = posts.groupBy("token").agg(F.collect_list("rule").alias("rules"))
    posts = scratch.table(posts.join(common, "token"), "posts")
    found = join_unique(words, posts, ["token"], "urls").select("key", "tokens", F.explode("rules").alias("rule")).select("key", "tokens", "rule.*")
    found = found.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    rank = F.struct(-F.col("confidence"), -F.col("support"), F.size("rule_tokens"), "rule_id", "label")
    return found.groupBy("key").agg(F.min_by(F.struct("label", "rule_id"), rank).alias("mined"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", min_support: float = 0.002, min_rows: int = 25, min_confidence: float = 0.7, min_lift: float = 1.1, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule for each row of pages.

    labels(id_col, label): rows with a null id or label take no part. An explicit rule decides; else the best mined
    rule; else `default`. A null URL, or one without ://, has an empty host and path and gets the default verdict.
    Rows are judged through their distinct URLs, so repeated rows and ids are safe.
    """
    scratch = Scratch(pages.sparkSession, "url-rules")
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parsed = rows.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    named = labels.select(F.col(id_col).alias("page_id"), F.col("label")).filter("page_id is not null and label is not null")
    labelled = parsed.join(named, "page_id").select(url_tokens(url, F.col("host"), F.col("path")).alias("tokens"), "label")
    mined = scratch.table(prune_rules(scratch.table(mine_rules(labelled, min_support, min_rows, min_confidence, min_lift), "rules")), "pruned")
    ruled = explicit_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("ruled", ruled).withColumn("key", F.when(F.col("ruled").isNull() & (F.col("host") != ""), url))
    open_ = judged.filter("key is not null")
    distinct = open_.groupBy("key").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count("*").alias("rows"))
    distinct = scratch.table(distinct, "urls")
    matched = match_rules(distinct.select("key", url_tokens(F.col("key"), F.col("host"), F.col("path")).alias("tokens")), mined)
    matched = scratch.table(distinct.select("key", "rows").join(matched, "key", "left"), "matched")
    # Rows that a rule decides, or without a host, need no lookup; the pages of one hot URL meet its rule by broadcast.
    found = join_unique(open_, matched, ["key"], "rows", "left")
    rest = judged.filter("key is null").select("*", F.lit(None).cast(matched.schema["mined"].dataType).alias("mined"))
    out = found.select(*rest.columns).unionByName(rest)
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", "mined.label", F.lit(default)).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("mined.rule_id")).alias("mined_rule"))
