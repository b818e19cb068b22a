"""Documents with everything that operators have to bear."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators might use themselves.
    T.StructField("words", T.StringType()), T.StructField("symbol", T.LongType()), T.StructField("key", T.StringType()),
    T.StructField("start", T.IntegerType()), T.StructField("length", T.StringType()), T.StructField("fp", T.DoubleType()), T.StructField("n", T.LongType()),
    T.StructField("_id", T.LongType()), T.StructField("__n_name", T.StringType()), T.StructField("__spans", T.StringType()), T.StructField("x.y", T.LongType())])


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    out = []
    for i in range(words):
        word = "".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ré", "sti"]) for _ in range(1 + rng.randrange(vocabulary) % 4))
        out.append(word.capitalize() if i % 9 == 0 else word + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def messy_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, odd characters, copies, near copies, repeats, repeated rows, equal and null ids, a long text."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 70)
    near = base.split(" ")
    near[60] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n\r "), (4, "word"), (5, "two words"), (6, "a\x00b \x0b c\x1c d é 日本 𝔘 \x85\xa0e"), (7, base), (8, base), (9, " ".join(near)),
        (10, prose(rng, 200) + "\n" + passage), (11, passage + "\n" + prose(rng, 100)), (12, "same " * 300), (13, "same " * 120 + prose(rng, 60)),
        (14, "\n".join(["one line of words"] * 30)), (15, prose(rng, 9000)), (16, "x" * 40_000), (16, "another text with an equal id"), (17, prose(rng, 60)), (17, None),
        (-5, base + " end"), (None, passage), (None, base), (None, None), (18, "*** %%% $$$ " * 60), (19, "SHOUTED WORDS " * 10 + prose(rng, 60)), (20, passage + " " + passage)]
    rows += [(20, passage + " " + passage), (7, base)]  # repeated rows
    rows += [(100 + i, prose(rng, rng.randrange(1, 300))) for i in range(20)]
    return rows


def as_documents(spark, rows):
    full = [(i, t, "en" if k % 3 else None, f"s{k % 2}", None, "w", k, "k", k, "l", 0.5, k, 5, "n", "s", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCUMENTS)
