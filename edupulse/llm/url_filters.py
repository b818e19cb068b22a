"""URL filters: fixed rules first, then association rules mined from labelled URLs.

A URL is a set of tokens, marked by where they stand: ``s:`` scheme, ``h:`` words of the host, ``p:`` of the path, ``q:`` of the
rest. Spark's FP-growth mines the combinations of tokens that occur with a label ("block" or "allow") often
enough; a combination becomes a rule for a label if enough labelled pages hold both (``SHARE`` of all, ``LEAST`` at least) and
``CONFIDENCE`` of the pages that hold the combination have the label. A rule goes if dropping one of its tokens gives a rule
of the same label that is as sure. Rules are found by an inverted index on their rarest token. Of those that fit a URL, the
surest decides (then the one with more pages, with fewer tokens, the first in order); without any, the URL is allowed.

Tokens are first reduced to frequent ones, so pages collapse to few distinct token sets; counting and matching run on the sets.
FP-growth's itemsets are the power set of a transaction, so a URL of more than ``WINDOW`` frequent tokens is mined in runs of so
many: rules combine tokens within one run. Every candidate is counted again over whole URLs, so supports are exact.

Odd cases: a null URL, or one without ``://``, has an empty host and path and no tokens, and is allowed unless a fixed rule fits; a
page labelled both ways counts as blocked; repeated pages count as often as they occur; without labels there are no rules; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edupulse.llm.staging import stage
from edupulse.operators.sizes import broadcast_if_small
from edupulse.session import MAX_BROADCAST_ROWS

SHARE, LEAST = 0.005, 20
CONFIDENCE = 0.8
WINDOW = 12
BLOCK, ALLOW = "block", "allow"

# The contract's rules: host, path, verdict.
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(.*)$"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 2), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def tokens_of(url: Column) -> Column:
    """Marked words in the order of the URL, each once."""

    def marked(mark: str, group: int) -> Column:
        words = F.split(F.translate(_part(url, group), _UPPER, _LOWER), r"[^\p{L}\p{N}]+")
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(mark), w))

    return F.array_distinct(F.concat(marked("s:", 1), marked("h:", 2), marked("p:", 3), marked("q:", 4)))


def fixed_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls without any. For lists short enough for one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _reduced(urls: DataFrame, frequent: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``urls`` (with url) and their frequent tokens in the order of the URL."""
    few = [r[0] for r in frequent.select("token").limit(limit + 1).collect()]
    if len(few) <= limit:
        return urls.withColumn("tokens", F.array_intersect(tokens_of(F.col("url")), F.array(*map(F.lit, few)).cast("array<string>")))
    placed = urls.select("url").distinct().select("url", F.posexplode(tokens_of(F.col("url"))).alias("place", "token")).join(frequent, "token")
    sets = placed.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("held")).select("url", F.col("held.token").alias("tokens"))
    return urls.join(sets, "url", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def _holding(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a set and a rule whose tokens it holds: rules are looked up by their rarest token."""
    postings = rules.select(F.col("rarest").alias("token"), F.col("tokens").alias("wanted"), *[c for c in rules.columns if c not in ("tokens", "rarest")])
    return sets.select("*", F.explode("tokens").alias("token")).join(broadcast_if_small(postings), "token").filter(F.size(F.array_except("wanted", "tokens")) == 0)


def frequent_tokens(labelled: DataFrame, least: int) -> DataFrame:
    """(token, pages) of the tokens that may be part of a rule."""
    return labelled.select(F.explode(tokens_of(F.col("url"))).alias("token")).groupBy("token").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)


def mine(labelled: DataFrame, share: float = SHARE, least: int = LEAST, confidence: float = CONFIDENCE, limit: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, DataFrame] | None:
    """Rules (tokens, label, n, hits, confidence, rarest) from (url, blocked), and the frequent tokens; None without any."""
    labelled = stage(labelled.select("url", F.col("blocked").cast("boolean").alias("blocked")))
    pages = labelled.count()
    # Whole numbers decide: hundredths of a percent of the pages, rounded up.
    least = max(least, -(-round(share * 10_000) * pages // 10_000))
    if pages < least:
        return None
    frequent = stage(frequent_tokens(labelled, least))
    held = stage(_reduced(labelled, frequent, limit).select("tokens", "blocked"))
    # Transactions: runs of at most WINDOW tokens, with the label as an item that no token equals.
    size = F.size("tokens")
    run = F.transform(F.sequence(F.lit(1), F.greatest(size - WINDOW + 1, F.lit(1))), lambda i: F.slice("tokens", i, WINDOW))
    labels = F.when(F.col("blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    runs = stage(held.filter(size > 0).select(F.explode(run).alias("run"), labels.alias("label")).select(F.array_append("run", F.col("label")).alias("items")))
    n_runs = runs.count()
    if not n_runs:
        return None
    # Half a page less, as the product with the number of rows is rounded up.
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n_runs)).fit(runs).freqItemsets
    label_items = F.array(F.lit(BLOCK), F.lit(ALLOW))
    candidates = found.filter(F.arrays_overlap("items", label_items) & (F.size("items") > 1)).select(F.sort_array(F.array_except("items", label_items)).alias("tokens")).distinct()
    rarest = candidates.select("tokens", F.explode("tokens").alias("token")).join(broadcast_if_small(frequent), "token").groupBy("tokens").agg(
        F.min(F.struct("pages", "token")).alias("least"))
    candidates = stage(rarest.select("tokens", F.col("least.token").alias("rarest")))
    sets = held.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked"))
    counted = _holding(sets, candidates).groupBy("wanted", "token").agg(F.sum("n").alias("n"), F.sum("n_blocked").alias("n_blocked"))
    sides = F.explode(F.array(
        F.struct(F.lit(BLOCK).alias("label"), F.col("n_blocked").alias("hits")), F.struct(F.lit(ALLOW).alias("label"), (F.col("n") - F.col("n_blocked")).alias("hits"))))
    rules = counted.select(F.col("wanted").alias("tokens"), F.col("token").alias("rarest"), "n", sides.alias("side")).select("tokens", "rarest", "n", "side.*")
    rules = stage(rules.withColumn("confidence", F.col("hits") / F.col("n")).filter((F.col("hits") >= least) & (F.col("confidence") >= confidence)))
    shorter = rules.select(
        "tokens", "label", "confidence", F.explode(F.transform("tokens", lambda t: F.array_except("tokens", F.array(t)))).alias("part")).join(
        rules.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("simpler")), ["part", "label"]).filter("simpler >= confidence")
    return stage(rules.join(shorter.select("tokens", "label").distinct(), ["tokens", "label"], "left_anti")), frequent


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, limit: int = MAX_BROADCAST_ROWS, **thresholds) -> DataFrame:
    """(page_id, host, path, rule, verdict, learned) of every page; ``labelled``: (url, blocked)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, said = fixed_verdict(F.col("host"), F.col("path"), rules)
    told = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": name, "said": said})
    mined = mine(labelled, limit=limit, **thresholds)
    if mined is None:
        learned = told.withColumns({"label": F.lit(None).cast("string"), "learned": F.lit(None).cast("string")})
    else:
        mined, frequent = mined
        # Only tokens of rules count now, so fewer distinct sets remain.
        told = _reduced(told, mined.select(F.explode("tokens").alias("token")).distinct().join(frequent, "token"), limit).withColumn("tokens", F.sort_array("tokens"))
        sets = told.filter("said IS NULL").select("tokens").distinct()
        order = Window.partitionBy("tokens").orderBy(F.desc("confidence"), F.desc("n"), F.size("wanted"), F.array_join("wanted", " "), "label")
        best = _holding(sets, mined).withColumn("turn", F.row_number().over(order)).filter("turn = 1").select("tokens", "label", F.array_join("wanted", " ").alias("learned"))
        learned = told.join(broadcast_if_small(best), "tokens", "left")
    undecided = F.col("said").isNull()
    return learned.select(
        "page_id", "host", "path", "rule", F.coalesce("said", "label", F.lit(ALLOW)).alias("verdict"), F.when(undecided, F.col("learned")).alias("learned"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of the pages whose document is labelled: the last number of the path is its doc_id. Junk and toxic ones are blocked."""
    said = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("blocked"))
    number = F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    numbered = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id"))
    return numbered.join(said, "doc_id").select("url", "blocked")


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(pages, page_labels(pages, labels))
