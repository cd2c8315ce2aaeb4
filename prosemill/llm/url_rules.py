"""URL filtering: a short list of host and path rules, then association rules mined from labels.

Spark's FP-growth finds frequent combinations of a URL's tokens and its label. Combinations that
imply a label with enough support and confidence become rules. They are matched by an inverted
index: a rule hangs on its rarest token, a URL meets only the rules of its own tokens, and of those
the rule whose tokens the URL holds completely and whose confidence is highest speaks.

Every host label, path segment, query name and fragment is a token. What bounds the combinations is
their support alone; tokens that stand in exactly the same URLs are mined as one, so that long fixed
paths, however often they occur, don't give all subsets of their segments.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: URLs that a combination must stand in, whatever share of all that is.
LEAST_URLS = 5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def list_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none fits."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):  # the last that fits wins
        at, _, below = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + below))
        which, verdict = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(says)).otherwise(verdict)
    return which, verdict


def url_tokens(url: Column) -> Column:
    """What a URL is made of, as ``kind=value``, digits as #; empty for a url without ``://``."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[0-9]+", "#")
    of = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + "="), x))
    labels = F.split(plain(host_of(url)), r"\.")
    query = plain(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1))
    names = F.transform(F.split(query, "[&;]"), lambda x: F.substring_index(x, "=", 1))
    fragment = plain(F.regexp_extract(url, r"(?s)^.*?://[^#]*#(.*)", 1))
    return F.array_distinct(
        F.concat(
            of("tld", F.slice(labels, -1, 1)),
            of("host", F.slice(labels, 1, F.size(labels) - 1)),
            of("dir", F.split(plain(path_of(url)), "/")),
            of("arg", names),
            of("fragment", F.array(fragment)),
        )
    )


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, least_urls: int = LEAST_URLS) -> DataFrame:
    """``rule_id, tokens, label, confidence, support`` from rows of ``tokens, label``.

    Tokens of the same URLs are found by their number and the sum of a hash of each URL's tokens;
    the first of them in code point order stands for all. Tokens that alone are too rare can't be
    part of a combination that isn't, and go before mining.
    """
    labelled = materialize(labelled.where(F.size("tokens") > 0), "url-bags")
    total = labelled.count()
    if not total:
        none = "rule_id string, tokens array<string>, label string, confidence double, support double"
        return labelled.sparkSession.createDataFrame([], none)
    least = max(least_urls, math.ceil(min_support * total))
    # Sums of a decimal type don't overflow, and are the same in any order.
    hashed = F.xxhash64("tokens").cast("decimal(38,0)")
    each = labelled.select(hashed.alias("bag"), F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("bag").alias("bags")).where(F.col("n") >= least)
    # Frequent tokens alone; the smallest of equal ones stands for them.
    stands = seen.groupBy("n", "bags").agg(F.min("token").alias("token")).select("token")
    stands = materialize(stands, "url-tokens")
    numbered = labelled.select("*", F.monotonically_increasing_id().alias("row"))
    bags = numbered.select("row", "label", F.explode("tokens").alias("token")).join(stands, "token").groupBy("row", "label").agg(F.collect_list("token").alias("t"))
    bags = materialize(bags.select(F.array_append("t", F.concat(F.lit("says="), "label")).alias("items")), "url-items")
    kept = bags.count()
    if not kept:
        return mine_rules(labelled.limit(0), min_support, min_confidence, least_urls)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / kept), minConfidence=min_confidence).fit(bags)
    rules = model.associationRules.where(
        F.startswith(F.col("consequent")[0], F.lit("says=")) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("says=")))
    )
    return rules.select(
        F.array_join(F.array_sort("antecedent"), " ").alias("rule_id"),
        F.col("antecedent").alias("tokens"),
        F.substring(F.col("consequent")[0], 6, 1000).alias("label"),
        "confidence",
        (F.col("support") * kept / total).alias("support"),
    )


def match_rules(urls: DataFrame, rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """``key, label, rule_id``: for each row of ``key, tokens`` with a match, the rule that speaks.

    ``frequency``: ``token, n``. Highest confidence, then support, then most tokens, then name.
    """
    posts = rules.select("*", F.explode("tokens").alias("token")).join(frequency, "token")
    posts = posts.groupBy("rule_id", "label").agg(
        F.min(F.struct("n", "token"))["token"].alias("token"),
        F.first("tokens").alias("needs"),
        F.first("confidence").alias("confidence"),
        F.first("support").alias("support"),
    )
    posts = materialize(posts, "url-rules")
    met = urls.select("key", "tokens", F.explode("tokens").alias("token")).join(posts, "token")
    met = met.where(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("needs").alias("size"), "rule_id", "label"))
    return met.groupBy("key").agg(best.alias("best")).select("key", "best.label", "best.rule_id")


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    labels: DataFrame | None = None,
    min_support: float = 0.0005,
    min_confidence: float = 0.6,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule`` for every row of ``pages``.

    ``rules``: (rule, ``allow`` or ``block``), like ``("net/de/", "allow")``. ``labels``: rows of
    ``url, label`` to mine; by default the pages themselves, labelled by the rule list, with
    ``none`` for a page that no rule fits: so a token combination blocks other pages only if most
    of all pages with it are blocked. Where neither list nor mined rule speaks the verdict is
    ``allow``. Null urls and urls without ``://`` have empty host and path and no tokens. Ids aren't
    looked at: null and repeated ids are judged row by row, and other columns are ignored. An empty
    table gives an empty result.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens"))
    which, says = list_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", which.alias("rule"), says.alias("listed"))
    if labels is None:
        seen = base.select("tokens", F.coalesce("listed", F.lit("none")).alias("label"))
    else:
        seen = labels.select(url_tokens(F.col("url")).alias("tokens"), "label").where("label is not null")
    mined = mine_rules(seen, min_support, min_confidence).where(F.col("label").isin("allow", "block"))
    mined = materialize(mined, "url-mined")
    frequency = base.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # Rules depend on the tokens alone: each distinct set of tokens is matched once.
    sets = base.where("rule is null and size(tokens) > 0").select("tokens").distinct().select(F.col("tokens").alias("key"), "tokens")
    found = match_rules(sets, mined, frequency).select(F.col("key").alias("tokens"), F.col("label").alias("said"), F.col("rule_id").alias("mined_rule"))
    # Written out, so that Spark sends them to all executors if they are small and else can split a
    # set of tokens that very many pages share.
    found = materialize(found, "url-found")
    out = base.join(found, (base["tokens"] == found["tokens"]) & base["rule"].isNull(), "left")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("listed", "said", F.lit("allow")).alias("verdict"), "mined_rule"
    )
