"""Quality rules whose cutoffs carry a guarantee.

Base rule: under 50 words, or more than half of the words in three-word windows that the text
repeats. On top, four rates per text (symbols, capitals, repeated lines, repeated words; in
thousandths) are held against cutoffs that labelled documents choose, one per stratum (language) and
rule. A cutoff is valid if the false rejection rate of good documents is shown to be at most
``RISK`` / 4 by the exact binomial test: P(Bin(n, RISK / 4) <= k) <= level for k of n good documents
rejected. The grid of a rule is tested from the mildest cutoff on and ends at the first that fails
(fixed sequence, so no correction within a grid); the level is ``LEVEL`` divided by the number of
strata and rules. So with confidence 1 - ``LEVEL`` every stratum loses at most ``RISK`` of its good
documents, all rules together. Of the valid cutoffs the one that rejects most bad documents is used,
each good document counting as ``PENALTY`` bad ones; the milder one on ties; none if nothing is won.

All labelled documents are used. They are counted before any test, so the tests cost the same for any number of them.

DataFrame functions only. Odd cases: a null text has no words and fails the base rule; a null
language is a stratum of its own; labels without a document, with a null, or contradicting each
other for one doc_id are not used; without labels there are no cutoffs; repeated rows are judged
alike; other columns are carried along by ``filter_documents``; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edupulse.llm.staging import quoted, stage, text_or_empty
from edupulse.operators.sizes import broadcast_if_small

RISK = 0.02
LEVEL = 0.05
PENALTY = 10

RULES = ("symbols", "capitals", "lines", "repeats")
# Cutoffs of every rule, in thousandths, from the mildest on.
GRID = [1000, 900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 120, 100, 80, 60, 40, 20]

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"


def base_statistics(documents: DataFrame, *keep: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_capitals and n_lines."""
    text = text_or_empty()
    split = documents.select(
        *keep, F.regexp_count(text, F.lit(_SYMBOL)).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.array_remove(F.split(text, _SPACE), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD)).alias("_lines"))
    # A window of three words is known by the chained hash of its words.
    hashes = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(
        F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    counted = split.select(
        *keep, "n_symbols", "n_capitals", F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") > 3, hashes).alias("_hashes"))
    # Only texts with a repeated window sort theirs.
    repeated = counted.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda i: F.get("_sorted", i)["h"]
    places = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(places, lambda j: F.transform(
        F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.get("_sorted", j)["i"] + k))))
    return repeated.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("_sorted").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"), "n_capitals", "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * 1000 / F.col(whole))).otherwise(0).cast("long")


def rates() -> dict[str, Column]:
    return {"symbols": _rate("n_symbols", "n_words"), "capitals": _rate("n_capitals", "word_chars"),
            "lines": _rate("n_dup_lines", "n_lines"), "repeats": _rate("n_repeat_words", "n_words")}


def _stirling_error(x: Column) -> Column:
    """ln x! less Stirling's (x + 1/2) ln x - x + ln(2 pi) / 2, for whole x from 1 on."""
    x = x.cast("double")
    exact = [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - math.log(2 * math.pi) / 2 for i in range(1, 16)]
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return F.when(x < 16, F.get(F.array(*[F.lit(e) for e in exact]), x.cast("int") - 1)).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n, as a sum of terms from the last on, each from the one before.

    It ends at nine standard deviations below the mean or k, where terms are under 1e-17 of the largest.
    """
    odds, mean = (1 - p) / p, n * p
    few, all_ = k.cast("double"), n.cast("double")
    rest, off = all_ - few, few - mean
    # ln C(n, k) p^k (1 - p)^(n - k), by its deviance from the mean.
    last = F.when(k == 0, all_ * math.log1p(-p)).otherwise(
        _stirling_error(all_) - _stirling_error(few) - _stirling_error(rest) + F.log(all_ / (2 * math.pi * few * rest)) / 2
        - few * F.log1p(off / mean) + rest * F.log1p(off / rest))
    lowest = F.greatest(F.lit(0), F.floor(F.least(few, mean) - 9 * F.sqrt(mean) - 50)).cast("long")
    start = F.struct(last.cast("double").alias("term"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        F.sequence(k, lowest, F.lit(-1).cast("long")), start,
        lambda s, i: F.struct((s["term"] + F.log(F.greatest(i, F.lit(1)) / (n - i + 1) * odds)).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum")),
        lambda s: s["sum"])


def cutoffs(statistics: DataFrame, labels: DataFrame, *, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum: the cutoff of each rule, or null.

    ``statistics``: doc_id, lang and the base statistics of all documents. Labelled rows are counted
    by (stratum, rule, step of the grid), so skewed strata combine before the shuffle.
    """
    good = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("_low"), F.max("quality").alias("_good")).where("_low = _good").select("doc_id", "_good"))
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), value.alias("value")) for r, value in rates().items()]))
    rows = (statistics.where(~base_failed()).join(good, "doc_id")
            .select(F.coalesce("lang", F.lit("")).alias("stratum"), (F.col("_good") == 1).alias("good"), steps.alias("_s")).select("stratum", "good", "_s.*"))
    # The number of cutoffs that reject the value: the grid falls, so these are its last ones.
    passed = sum((F.when(F.col("value") >= c, 1).otherwise(0) for c in GRID), F.lit(0))
    counted = rows.groupBy("stratum", "rule", passed.alias("n_rejecting")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # A value that j cutoffs reject is rejected by those at positions len(GRID) - j and beyond.
    totals = counted.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"))
    grid = totals.withColumn("_g", F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(c).cast("long").alias("cutoff")) for i, c in enumerate(GRID)]))).select(
        "stratum", "rule", "n_good", "_g.*")
    rejected = (grid.join(counted, ["stratum", "rule"]).groupBy("stratum", "rule", "n_good", "step", "cutoff")
                .agg(F.sum(F.when(F.col("n_rejecting") >= len(GRID) - F.col("step"), F.col("good")).otherwise(0)).alias("good"),
                     F.sum(F.when(F.col("n_rejecting") >= len(GRID) - F.col("step"), F.col("bad")).otherwise(0)).alias("bad")))
    tests = totals.count()
    share = risk / len(RULES)
    # More rejected than expected at the limit cannot be significant.
    hopeful = F.col("good") <= F.floor(F.col("n_good") * share)
    valid = F.when(hopeful & (F.col("good") < F.col("n_good")), binomial_tail(F.col("good"), F.col("n_good"), share) <= level / max(tests, 1)).otherwise(False)
    upto = Window.partitionBy("stratum", "rule").orderBy("step")
    chosen = (rejected.withColumn("_valid", F.min(valid).over(upto)).where("_valid")
              .withColumn("_gain", F.col("bad") - PENALTY * F.col("good")).where("_gain > 0")
              .withColumn("_turn", F.row_number().over(Window.partitionBy("stratum", "rule").orderBy(F.desc("_gain"), "step"))).where("_turn = 1"))
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES])


def judge(statistics: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    small = broadcast_if_small(limits.withColumnRenamed("stratum", "_stratum"))
    over = [F.coalesce(value >= F.col(f"_cut_{r}"), F.lit(False)) for r, value in rates().items()]
    rejected = over[0] | over[1] | over[2] | over[3]
    return (statistics.join(small, F.coalesce("lang", F.lit("")) == F.col("_stratum"), "left")
            .withColumn("base_failed", base_failed()).withColumn("kept", ~(base_failed() | rejected)))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics and the verdict of every document."""
    statistics = stage(base_statistics(documents, "doc_id", "lang"))
    return judge(statistics, stage(cutoffs(statistics, labels))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are kept."""
    limits = stage(cutoffs(stage(base_statistics(documents, "doc_id", "lang")), labels))
    whole = documents.select(F.struct(*quoted(documents.columns)).alias("_row"), "text", "lang")
    counted = base_statistics(whole, "_row", "lang")
    # Filters do not pass a generator, so that the statistics are computed once and not in every condition.
    numbers = [c for c in counted.columns if c != "_row"]
    once = counted.select("_row", F.explode(F.array(F.struct(*numbers))).alias("_s")).select("_row", "_s.*")
    return judge(once, limits).where("kept").select("_row.*")
