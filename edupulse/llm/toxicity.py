"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Words are compared as strings of letters with a mark at either end: the kernel counts the common
subsequences of three within a span of ``SPAN`` letters, each weighted down by its gaps, so an insult
with letters inserted, left out or set apart stays close to the plain one. It is normalised and
squared; likeness under ``FLOOR`` counts as none. Landmarks are insult candidates and the ordinary
words most like them; the kernel values to them, whitened by the kernel among them (Nyström), are
the features of a support vector machine.

It is trained on sentences by their words: a sentence of a toxic document is toxic by the candidates
in it (as written, and with a letter inserted), one of another document by none of its words.
Candidates are words that occur in far more toxic than other documents by a likelihood ratio, a family
of near copies counting about once. A sentence's margin is that of its worst word, a document's that
of its worst sentence, calibrated to a probability.

Training reads at most about ``SAMPLE`` documents of each label (by the hash of doc_id; a documented
bound). Scoring reads every document, whole. A task keeps the margins of words it has met,
``MEMORY`` of them at most.

Only the text is an input of a score. Labels are learnt from rows with crc32(doc_id as text) mod 3
other than 1.

Odd cases: a null text is empty; a text without words has the margin of a word that resembles no
landmark; labels that are null or contradict each other for one doc_id are not learnt; without labels
of both kinds, or candidates, every score is the share of toxic labels (0 without any); repeated rows
score alike; a null doc_id is not held out; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from edupulse.llm.staging import stage, steps, text_or_empty

THRESHOLD = 0.7
SAMPLE = 4_000
INSULT_LANDMARKS, PLAIN_LANDMARKS = 48, 32
CANDIDATES = 1_000
SKETCHES = 4
NEAR_WORDS = 20_000
MEMORY = 400_000

SPAN = 5
DECAY = 0.6
# A word that resembles a landmark less than this does not resemble it at all.
FLOOR = 0.25
_CODES = 42
_WINDOW = 24
_RIDGE = 1e-4

_SPELLED_LETTERS = 4
# Characters commonly written for letters (fixed values).
_LIKE_LETTERS = str.maketrans("013457@$", "oieastas")
_OFFSETS = [(a, b, DECAY ** (b - 2)) for a, b in itertools.combinations(range(1, SPAN), 2)]


def letters(word: str) -> str:
    """The word's letters in lower case; look-alikes inside it are read as letters, marks left out."""
    word = word.lower()
    if not word.isalpha():
        start, end = 0, len(word)
        while start < end and not word[start].isalpha():
            start += 1
        while end > start and not word[end - 1].isalpha():
            end -= 1
        word = "".join(c for c in word[start:end].translate(_LIKE_LETTERS) if c.isalpha())
    return word


def split_words(text: str) -> list[str]:
    """The text's words in lower case; letters spaced out one by one ("a b c d") also as one word."""
    words = text.lower().split()
    if list(map(len, words)).count(1) >= _SPELLED_LETTERS:
        for single, run in itertools.groupby(words[:], lambda w: len(w) == 1):
            if single and len(spelled := letters("".join(run))) >= _SPELLED_LETTERS:
                words.append(spelled)
    return words


def _codes(words: list[str]) -> np.ndarray:
    """The words' letters as numbers under ``_CODES``, a row per word: the start mark first, the end mark and -1 behind."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letter = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    table = np.full((len(words), int(sizes.max(initial=0)) + 1 + SPAN), -1, np.int64)
    table[:, 0] = 0
    table[np.arange(len(words)), sizes + 1] = _CODES - 1
    row = np.repeat(np.arange(len(words)), sizes)
    table[row, np.arange(len(letter)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1] = np.where(
        (letter >= 97) & (letter <= 122), letter - 96, 27 + letter % 13)
    return table


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, float]]:
    """For every pair of offsets the words' subsequences of three (a row per word, padded by _CODES ** 3) and the weight."""
    table = _codes(words)
    width = table.shape[1]
    for a, b, weight in _OFFSETS:
        x, y, z = table[:, : width - b], table[:, a: width - b + a], table[:, b:]
        # A word's letters are contiguous, so the last one of the three tells if all are there.
        yield np.where(z < 0, _CODES**3, (x * _CODES + y) * _CODES + z), weight


@dataclass
class Kernel:
    """Kernel values of words to fixed landmarks."""

    landmarks: list[str]
    place: np.ndarray = field(init=False)  # of a subsequence in features; -1 if no landmark has it
    features: np.ndarray = field(init=False)

    def __post_init__(self):
        whole = np.zeros((_CODES**3 + 1, len(self.landmarks)), np.float32)
        norm = np.zeros(len(self.landmarks))
        for grams, weight in _grams(self.landmarks):
            norm += (grams < _CODES**3).sum(1) * weight**2
            for i, row in enumerate(grams):
                np.add.at(whole[:, i], row, np.float32(weight))
        whole[-1] = 0
        present = np.flatnonzero(whole.any(1))
        self.place = np.full(len(whole), -1, np.int32)
        self.place[present] = np.arange(len(present))
        self.features = (whole[present] / np.maximum(np.sqrt(norm), 1e-9)).astype(np.float32)

    def values(self, words: list[str]) -> np.ndarray:
        """One row per word. Words of similar length are taken together."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 512):
            rows = order[at: at + 512]
            mine = [words[i] for i in rows]
            total, norm = np.zeros((len(mine), len(self.landmarks)), np.float32), np.zeros(len(mine))
            for grams, weight in _grams(mine):
                norm += (grams < _CODES**3).sum(1) * weight**2
                place = self.place[grams]
                row, column = np.nonzero(place >= 0)
                if len(row):
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    total[row[first]] += np.add.reduceat(self.features[place[row, column]], first, axis=0) * np.float32(weight)
            total /= np.maximum(np.sqrt(norm), 1e-9)[:, None]
            total[total < FLOOR] = 0
            out[rows] = total * total
        return out


@dataclass
class Model:
    """A fitted scorer. A word's margin is linear in its kernel values; two numbers turn a document's into a probability."""

    landmarks: list[str]
    weights: np.ndarray
    constant: float
    slope: float
    offset: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


class Scorer:
    """Margins of texts under a model, with the words met so far."""

    def __init__(self, model: Model):
        self.model, self.kernel = model, Kernel(model.landmarks)
        self.known: dict[str, float] = {}  # as written
        self.by_letters: dict[str, float] = {}

    def _learn(self, spellings: list[str]) -> None:
        """Long words have the worst margin of their overlapping windows."""
        by_letters = self.by_letters
        plain = [letters(s) for s in spellings]
        new = [w for w in set(plain) if w not in by_letters]
        parts, owner = [], []
        for i, word in enumerate(new):
            cut = [word] if len(word) <= _WINDOW else [word[at: at + _WINDOW] for at in range(0, len(word) - _WINDOW // 2, _WINDOW // 2)]
            parts += cut
            owner += [i] * len(cut)
        worst = np.full(len(new), -np.inf)
        for at in range(0, len(parts), 8192):
            margin = self.kernel.values(parts[at: at + 8192]) @ self.model.weights + self.model.constant
            np.maximum.at(worst, owner[at: at + 8192], margin)
        by_letters.update(zip(new, worst.tolist(), strict=True))
        self.known.update((s, by_letters[w]) for s, w in zip(spellings, plain, strict=True))

    def margins(self, texts: Iterable[str]) -> np.ndarray:
        split = [set(split_words(t)) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known, self.by_letters = {}, {}
            new = set().union(*split)
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        return np.array([max(map(get, words), default=self.model.constant) for words in split], float)


_SCORERS: dict[tuple, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """A worker's scorer for this model."""
    key = (*model.landmarks, *model.weights.tolist(), model.constant)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(documents: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of the training sample, and the number of learnable labels of each kind."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.min("toxic").alias("_low"), F.max("toxic").alias("toxic")).where("_low = toxic").select("doc_id", "toxic")
             .where(~held_out(F.col("doc_id"))))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    wanted = F.lit(False)
    for label, n in counts.items():
        wanted = wanted | ((F.col("toxic") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample))
    # About ``sample`` rows of each label; so small a table is sent to the texts.
    return documents.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known.where(wanted)), "doc_id"), counts


def _counts(sample: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(word, a, b): in how many toxic and other documents; and the documents of either kind.

    A document weighs one by the number of documents of its label that share its most common sketch (the
    least hash of its runs of three words, of ``SKETCHES`` kinds), so that a family of near copies counts about once.
    """
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            split = [split_words(text) for text in batch.column("text").to_pylist()]
            words = [sorted({w for x in set(mine) if 2 < len(w := letters(x)) <= _WINDOW}) for mine in split]
            triples = [{" ".join(mine[i: i + 3]) for i in range(max(len(mine) - 2, 1))} for mine in split]
            least = [[min(xxh64_intdigest(t, k) for t in mine) >> 1 for k in range(SKETCHES)] for mine in triples]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(least, pa.list_(pa.int64()))],
                                             names=["toxic", "words", "least"])

    documents = stage(sample.mapInArrow(describe, "toxic int, words array<string>, least array<long>").withColumn("row", F.monotonically_increasing_id()))
    sketches = documents.select("row", "toxic", F.posexplode("least").alias("k", "sketch"))
    common = sketches.groupBy("toxic", "k", "sketch").agg(F.count(F.lit(1)).alias("n"))
    weights = sketches.join(common, ["toxic", "k", "sketch"]).groupBy("row").agg((1 / F.max("n")).alias("weight"))
    weighted = stage(documents.join(weights, "row").select("toxic", "weight", "words"))
    totals = {r["toxic"]: r["n"] for r in weighted.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    counted = weighted.select("toxic", "weight", F.explode("words").alias("word")).groupBy("word").agg(
        *[F.sum(F.when(F.col("toxic") == label, F.col("weight")).otherwise(0.0)).alias(name) for label, name in ((1, "a"), (0, "b"))])
    return stage(counted), totals


def _candidates(counted: DataFrame, n1: float, n0: float) -> list[tuple[str, float]]:
    """Words far more frequent in toxic documents, by the likelihood ratio, the most significant first, with their count there."""
    a, b = F.col("a"), F.col("b")
    share = (a + b) / (n1 + n0)

    def part(k: Column, n: float) -> Column:
        inside = F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
        return inside + F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0)

    scored = counted.where((a >= 3) & (a / n1 > 8 * b / n0) & (a + b < n1 + n0)).withColumn("g", 2 * (part(a, n1) + part(b, n0))).where("g > 12")
    return [(r["word"], r["a"]) for r in scored.orderBy(F.desc("g"), "word").limit(CANDIDATES).collect()]


def _near_words(counted: DataFrame, insults: list[str], listed: frozenset[str]) -> list[tuple[str, float, float]]:
    """Words of other documents that resemble an insult landmark, the most alike first: word, likeness, count."""
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(insults)
        for batch in batches:
            words = batch.column("word").to_pylist()
            best = kernel.values(words).max(1)
            keep = [i for i in np.flatnonzero(best > 0) if words[i] not in listed]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in keep], pa.string()), pa.array(best[keep].astype(float)), batch.column("b").take(pa.array(keep, pa.int64()))], names=["word", "like", "b"])

    rows = counted.where("b > 0").select("word", "b").mapInArrow(alike, "word string, like double, b double")
    return [tuple(r) for r in rows.orderBy(F.desc("like"), "word").limit(NEAR_WORDS).collect()]


def _spread(candidates: list[str], count: int) -> list[str]:
    """The first candidate and then, again and again, the one least like those chosen, earlier ones favoured."""
    chosen = candidates[:1]
    best = np.zeros(len(candidates))
    rank = 1 / (1 + np.arange(len(candidates)) / 50)
    while len(chosen) < min(count, len(candidates)):
        best = np.maximum(best, Kernel(chosen[-1:]).values(candidates)[:, 0])
        gain = np.where(np.isin(candidates, chosen), -1, (1 - np.minimum(best, 1)) * rank)
        if gain.max() <= 0.05:
            break
        chosen.append(candidates[int(gain.argmax())])
    return chosen


def _with_insertion(word: str) -> str:
    """The word with a letter inserted, by hash: what the machine is to tolerate is among its examples."""
    word = letters(word)
    number = xxh64_intdigest(word)
    at = 1 + number % max(len(word) - 1, 1)
    return word[:at] + chr(97 + number // 1009 % 26) + word[at:]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and constant of a linear support vector machine with squared hinge loss, classes balanced, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    cost = 0.5 * weight / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
    w = np.zeros(x.shape[1])
    penalty = _RIDGE * np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(100):
        active = y * (x @ w) < 1
        xa = x[active] * cost[active, None]
        new = np.linalg.solve(2 * xa.T @ x[active] + np.diag(penalty), 2 * xa.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _calibrate(margins: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic fit, with a weak pull to zero."""
    x = np.column_stack([margins, np.ones(len(margins))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (toxic - p)) - 1e-3 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    chosen, counts = _sample(documents, labels, sample)
    chosen = stage(chosen)
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    constant = Model(["toxic"], np.zeros(1), 0.0, 0.0, float(np.log(max(share, 1e-13) / max(1 - share, 1e-13))))
    size = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return constant
    counted, totals = _counts(chosen)
    candidates = _candidates(counted, totals[1], totals[0])
    if not candidates:
        return constant
    listed = frozenset(w for w, _ in candidates)
    insults = _spread([w for w, _ in candidates], INSULT_LANDMARKS)
    near = _near_words(counted, insults, listed)
    landmarks = insults + _spread([w for w, _, _ in near], PLAIN_LANDMARKS)

    # Examples by distinct words, each weighing as the root of its documents; a word that resembles nothing stands for the rest.
    words = [w for w, _ in candidates] + [_with_insertion(w) for w, _ in candidates] + [w for w, _, _ in near] + ["zzz"]
    y = np.array([1.0] * (2 * len(candidates)) + [-1.0] * (len(near) + 1))
    often = np.sqrt([a for _, a in candidates])
    weight = np.concatenate([often, often / 2, np.sqrt([b for _, _, b in near]), [1.0]])
    # Nyström: kernel values to landmarks, whitened by the landmarks' own.
    kernel = Kernel(landmarks)
    own = kernel.values(landmarks).astype(float)
    spread, axes = np.linalg.eigh((own + own.T) / 2)
    whiten = axes / np.sqrt(np.maximum(spread, 1e-2))
    weights, bias = _machine(kernel.values(words) @ whiten, y, weight)
    model = Model(landmarks, whiten @ weights, bias, 1.0, 0.0)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts, toxic = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
            for text, label in list(zip(texts, toxic, strict=True)):
                changed = " ".join([_with_insertion(w) if letters(w) in listed else w for w in text.split(" ")]) if label else text
                if changed != text:
                    texts.append(changed)
                    toxic.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(_scorer(model).margins(texts))], names=["toxic", "margin"])

    scored = chosen.mapInArrow(margins, "toxic int, margin double").collect()
    toxic = np.array([r["toxic"] for r in scored], float)
    weight = np.where(toxic > 0, counts[1] / max(toxic.sum(), 1), counts[0] / max((1 - toxic).sum(), 1))
    slope, offset = _calibrate(np.array([r["margin"] for r in scored]), toxic, weight / weight.mean())
    return Model(landmarks, model.weights, bias, slope, offset)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = model.probability(_scorer(model).margins(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    read = documents.select("doc_id", text_or_empty().alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(scores, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(documents, labels))
