"""Fitting the tracing parameters (K4, K5).

Chains are reduced to their outcome strings with counts, since equal strings contribute equal
statistics. Each iteration maps over the distinct strings and brings eight sums to the driver.
A chain too long for one task stays in segments: per iteration every segment's 2x2 transfer
matrix is computed, and the state before and the evidence after each segment follow from them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edupulse.operators.mastery import ATTEMPT_ORDER, CHAIN_KEYS, INITIAL_BKT, BktRule, mastery_before
from edupulse.operators.metrics import LOG_CLIP
from edupulse.operators.skew import SEGMENT, join_segment_values, split_hot
from edupulse.session import max_rows_per_group, ship_package

EPS = 1e-4  # slip and guess stay this far from 0 and 1
MAX_CHAIN = 100_000  # longer chains are fitted by segment
# Iteration counts tried on the validation students.
ITERATION_CANDIDATES = (5, 10, 15, 20, 25, 30, 40)
SUMS = ["l0", "chains", "trans_num", "trans_den", "slip_num", "slip_den", "guess_num", "guess_den"]
_SUM_SCHEMA = ", ".join(f"{name} double" for name in SUMS)
_BLOCK_CELLS = 2_000_000  # outcomes held in arrays at a time
TASK_CELLS = 500_000  # outcomes that a task takes in an iteration


def _bits():
    """Outcome string of the attempts in a group, in order."""
    rows = F.sort_array(F.collect_list(F.struct(*ATTEMPT_ORDER, F.col("correct").alias("_ok"))))
    return F.array_join(F.transform(rows, lambda x: F.when(x["_ok"], "1").otherwise("0")), "").alias("bits")


def _emissions(bits: np.ndarray, rule: BktRule) -> tuple[np.ndarray, np.ndarray]:
    """P(outcome | unknown), P(outcome | known), elementwise."""
    return (np.where(bits, rule.guess, 1.0 - rule.guess), np.where(bits, 1.0 - rule.slip, rule.slip))


def chain_statistics(
    bits: np.ndarray, lengths: np.ndarray, weight: np.ndarray, rule: BktRule,
    before: np.ndarray | None = None, after: np.ndarray | None = None,
    first: np.ndarray | None = None, last: np.ndarray | None = None,
) -> np.ndarray:
    """Expected counts of chains in the order of ``SUMS``.

    ``bits`` is chains x longest length, padded at the end. ``before`` is the state distribution
    before the first outcome and ``after`` the evidence after the last one, for segments of longer
    chains; whole chains need neither.
    """
    n, longest = bits.shape
    t = rule.transit
    e0, e1 = _emissions(bits, rule)
    if before is None:
        before = np.tile([1.0 - rule.prior, rule.prior], (n, 1))
    ends = np.ones((n, 2)) if after is None else after
    first = np.ones(n, bool) if first is None else first
    last = np.ones(n, bool) if last is None else last

    f0, f1 = np.empty((longest, n)), np.empty((longest, n))  # filtered state, scaled to sum to 1
    p0, p1 = before[:, 0], before[:, 1]
    for i in range(longest):
        a0, a1 = p0 * e0[:, i], p1 * e1[:, i]
        total = a0 + a1
        f0[i], f1[i] = a0 / total, a1 / total
        p0, p1 = f0[i] * (1.0 - t), f1[i] + f0[i] * t

    sums = np.zeros(len(SUMS))
    b0, b1 = ends[:, 0], ends[:, 1]
    known_next = np.ones(n)
    for i in range(longest - 1, -1, -1):
        live, inner = lengths > i, lengths > i + 1
        norm = f0[i] * b0 + f1[i] * b1
        w = np.where(live, weight, 0.0)
        g0, g1 = f0[i] * b0 / norm * w, f1[i] * b1 / norm * w
        right = bits[:, i]
        sums[7] += g0.sum()
        sums[5] += g1.sum()
        sums[6] += g0[right].sum()
        sums[4] += g1[~right].sum()
        # The step out of outcome i, unless it ends its chain. At the end of a segment the
        # evidence of arriving known is the one handed in.
        moves = inner | ~last
        arrive = np.where(inner, known_next, b1)
        sums[2] += (f0[i] * t * arrive / norm * w)[moves].sum()
        sums[3] += g0[moves].sum()
        if i == 0:
            sums[0] += g1[first].sum()
            sums[1] += w[first].sum()
        known, unknown = e1[:, i] * b1, e0[:, i] * b0
        back = (1.0 - t) * unknown + t * known
        scale = np.maximum(back, known)
        b0 = np.where(live, back / scale, b0)
        b1 = np.where(live, known / scale, b1)
        known_next = known / scale
    return sums


def transfer_matrix(bits: np.ndarray, rule: BktRule) -> tuple[float, float, float]:
    """Upper-triangular product of (emission x transition) over one segment, scaled."""
    e0, e1 = _emissions(bits, rule)
    m00, m01, m11 = 1.0, 0.0, 1.0
    for u, k in zip(e0, e1, strict=True):
        m01 = m00 * u * rule.transit + m01 * k
        m00, m11 = m00 * u * (1.0 - rule.transit), m11 * k
        scale = max(m00, m01, m11)
        m00, m01, m11 = m00 / scale, m01 / scale, m11 / scale
    return m00, m01, m11


def _as_array(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Padded 0/1 array and the lengths of outcome strings."""
    lengths = np.array([len(x) for x in strings])
    bits = np.zeros((len(strings), lengths.max()), bool)
    bits[np.arange(bits.shape[1]) < lengths[:, None]] = np.frombuffer("".join(strings).encode(), np.uint8) == ord("1")
    return bits, lengths


def _blocks(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of similar length together, a bounded number of outcomes at a time."""
    lengths = frame["bits"].str.len().to_numpy()
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        shortest = lengths[order[at]]
        longest = shortest + shortest // 4 + 4
        end = at + int(np.searchsorted(lengths[order[at:]], longest, side="right"))
        end = min(end, at + max(1, _BLOCK_CELLS // int(longest)))
        yield frame.iloc[order[at:end]]
        at = end


def _e_step(rule: BktRule):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(SUMS))
        for frame in frames:
            for part in _blocks(frame):
                extra = {}
                if "before0" in part:
                    extra = {
                        "before": part[["before0", "before1"]].to_numpy(),
                        "after": part[["after0", "after1"]].to_numpy(),
                        "first": part["first"].to_numpy(bool),
                        "last": part["last"].to_numpy(bool),
                    }
                sums += chain_statistics(
                    *_as_array(part["bits"].tolist()), part["weight"].to_numpy(float), rule, **extra)
        yield pd.DataFrame([sums], columns=SUMS)

    return run


def _with_context(segments: DataFrame, rule: BktRule) -> DataFrame:
    """Segments with the state before and the evidence after each, for the current parameters."""
    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells = [transfer_matrix(_as_array([b])[0][0], rule) for b in frame["bits"]]
            yield frame[[*CHAIN_KEYS, SEGMENT]].assign(**{
                name: [c[i] for c in cells] for i, name in enumerate(("m00", "m01", "m11"))})

    fields = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    keys = ", ".join(f"{c} {fields[c]}" for c in [*CHAIN_KEYS, SEGMENT])
    per_segment = segments.mapInPandas(matrices, f"{keys}, m00 double, m01 double, m11 double")
    t, prior = rule.transit, rule.prior

    def thread(frame: pd.DataFrame) -> pd.DataFrame:
        """One chain's segments: forward for the states, backward for the evidence."""
        frame = frame.sort_values(SEGMENT)
        cells = frame[["m00", "m01", "m11"]].to_numpy()
        before, after = np.empty((len(cells), 2)), np.empty((len(cells), 2))
        state = np.array([1.0 - prior, prior])
        for i, (m00, m01, m11) in enumerate(cells):
            before[i] = state
            state = np.array([state[0] * m00, state[0] * m01 + state[1] * m11])
            state /= state.sum()
        evidence = np.ones(2)
        for i in range(len(cells) - 1, -1, -1):
            m00, m01, m11 = cells[i]
            after[i] = (1.0 - t) * evidence[0] + t * evidence[1], evidence[1]
            evidence = np.array([m00 * evidence[0] + m01 * evidence[1], m11 * evidence[1]])
            evidence /= evidence.max()
        place = np.arange(len(cells))
        return frame[[*CHAIN_KEYS, SEGMENT]].assign(
            before0=before[:, 0], before1=before[:, 1], after0=after[:, 0], after1=after[:, 1],
            first=place == 0, last=place == len(cells) - 1)

    # One three-number row per segment: a millionth of the rows of a chain at the default limit.
    context = per_segment.groupBy(*CHAIN_KEYS).applyInPandas(
        thread, f"{keys}, before0 double, before1 double, after0 double, after1 double, first boolean, last boolean")
    return join_segment_values(segments, context, CHAIN_KEYS)


@dataclass
class ChainStore:
    """Compressed chains of one attempt set, cached for the iterations."""

    whole: DataFrame
    segments: DataFrame | None
    tasks: int

    def close(self) -> None:
        self.whole.unpersist()
        if self.segments is not None:
            self.segments.unpersist()


def compress_chains(attempts: DataFrame, *, max_chain: int | None = None) -> ChainStore:
    """Outcome strings with counts, and the segments of over-long chains."""
    ship_package()
    limit = max_chain or min(MAX_CHAIN, max_rows_per_group(attempts.sparkSession))
    rows = attempts.select(*CHAIN_KEYS, *ATTEMPT_ORDER, "correct")
    ordinary, hot = split_hot(rows, CHAIN_KEYS, ATTEMPT_ORDER, limit)
    whole = ordinary.groupBy(*CHAIN_KEYS).agg(_bits()).groupBy("bits").agg(F.count(F.lit(1)).alias("weight"))
    segments = None
    if hot is not None:
        segments = hot.groupBy(*CHAIN_KEYS, SEGMENT).agg(_bits()).withColumn("weight", F.lit(1).cast("long")).persist()
    whole = whole.persist()
    # Every iteration starts these tasks again, so there are as many as the outcomes need and not as the shuffle left.
    cells = whole.agg(F.sum(F.length("bits"))).first()[0] or 0
    return ChainStore(whole, segments, max(1, -(-cells // TASK_CELLS)))


def _em_step(store: ChainStore, rule: BktRule) -> BktRule:
    parts = store.whole.coalesce(store.tasks).mapInPandas(_e_step(rule), _SUM_SCHEMA)
    if store.segments is not None:
        parts = parts.unionByName(_with_context(store.segments, rule).mapInPandas(_e_step(rule), _SUM_SCHEMA))
    row = parts.agg(*[F.sum(c).alias(c) for c in SUMS]).first()
    if not row["chains"]:
        raise ValueError("fitting needs at least one attempt")

    def share(num: str, den: str, keep: float, eps: float = 0.0) -> float:
        value = row[num] / row[den] if row[den] > 0 else keep
        return min(1.0 - eps, max(eps, value))

    return BktRule(
        prior=share("l0", "chains", rule.prior),
        transit=share("trans_num", "trans_den", rule.transit),
        slip=share("slip_num", "slip_den", rule.slip, EPS),
        guess=share("guess_num", "guess_den", rule.guess, EPS),
    )


def fit_path(
    attempts: DataFrame, *, n_iter: int, initial: BktRule | None = None, max_chain: int | None = None
) -> list[BktRule]:
    """Parameters after 1, 2, … ``n_iter`` iterations; only the parameters pass between them."""
    store = compress_chains(attempts, max_chain=max_chain)
    rule, path = initial or BktRule(*INITIAL_BKT), []
    try:
        for _ in range(n_iter):
            rule = _em_step(store, rule)
            path.append(rule)
    finally:
        store.close()
    return path


def fit_bkt(
    attempts: DataFrame, *, n_iter: int = 20, initial: BktRule | None = None, max_chain: int | None = None
) -> BktRule:
    """K4: one parameter set pooled over all chains."""
    return fit_path(attempts, n_iter=n_iter, initial=initial, max_chain=max_chain)[-1]


@dataclass(frozen=True)
class Selection:
    params: BktRule
    n_iter: int
    val_log_loss: dict[int, float]


class _ParameterColumns(BktRule):
    """A rule whose parameters are columns of the row it is applied to."""

    def __post_init__(self) -> None:
        pass


def candidate_losses(attempts: DataFrame, rules: Sequence[BktRule], *, max_rows: float | None = None) -> DataFrame:
    """(candidate, log_loss, n): the log loss of every rule's predictions, ``candidate`` being its place in ``rules``.

    One shuffle for all of them: chains are reduced to their outcomes, equal ones are counted, and each is folded once a
    rule with the state and its loss so far. Over-long chains are traced by segment, with the rule as part of the key.
    """
    names = ("prior", "transit", "slip", "guess")
    each = F.explode(F.array(*[
        F.struct(F.lit(i).alias("candidate"), *[F.lit(float(getattr(r, n))).alias(n) for n in names]) for i, r in enumerate(rules)])).alias("_p")
    rule = _ParameterColumns(*[F.col(n) for n in names])

    def loss(mastery: Column, correct: Column) -> Column:
        p = F.least(F.lit(1.0 - LOG_CLIP), F.greatest(F.lit(LOG_CLIP), F.round(rule.predict(mastery), 12)))
        return -F.log(F.when(correct, p).otherwise(1.0 - p))

    rows = attempts.select(*CHAIN_KEYS, *ATTEMPT_ORDER, F.col("correct").cast("boolean").alias("correct"))
    ordinary, hot = split_hot(rows, CHAIN_KEYS, ATTEMPT_ORDER, max_rows)
    in_order = F.sort_array(F.collect_list(F.struct(*ATTEMPT_ORDER, F.col("correct").alias("_ok"))))
    chains = ordinary.groupBy(*CHAIN_KEYS).agg(F.transform(in_order, lambda x: x["_ok"]).alias("_chain"))
    chains = chains.groupBy("_chain").agg(F.count(F.lit(1)).alias("_weight"))
    folded = F.aggregate(
        "_chain", F.struct(F.col("prior").alias("m"), F.lit(0.0).alias("loss")),
        lambda acc, ok: F.struct(rule.step(acc["m"], ok).alias("m"), (acc["loss"] + loss(acc["m"], ok)).alias("loss")))
    losses = chains.select("_chain", "_weight", each).select("_chain", "_weight", "_p.*").select(
        "candidate", (folded["loss"] * F.col("_weight")).alias("loss"), (F.size("_chain") * F.col("_weight")).alias("n"))
    if hot is not None:
        tagged = hot.drop(SEGMENT).select("*", each).select(*rows.columns, "_p.*")
        traced = mastery_before(tagged, rule, keys=(*CHAIN_KEYS, "candidate", *names), max_rows=max_rows)
        losses = losses.unionByName(traced.select("candidate", loss(F.col("mastery_before"), F.col("correct")).alias("loss"), F.lit(1).cast("long").alias("n")))
    return losses.groupBy("candidate").agg((F.sum("loss") / F.sum("n")).alias("log_loss"), F.sum("n").alias("n"))


def select_bkt(
    train_fit: DataFrame, val: DataFrame, *, candidates: Sequence[int] = ITERATION_CANDIDATES
) -> Selection:
    """K5: the iteration count of lowest validation log loss, refitted on train-fit and val.

    Every candidate starts from the same point, so one run passes through all of them, and one
    pass over the validation rows evaluates all.
    """
    path = fit_path(train_fit, n_iter=max(candidates))
    found = {r["candidate"]: r["log_loss"] for r in candidate_losses(val, [path[n - 1] for n in candidates]).collect()}
    if not found:
        raise ValueError("selection needs at least one validation attempt")
    losses = {n: found[i] for i, n in enumerate(candidates)}
    best = min(candidates, key=losses.__getitem__)
    return Selection(fit_bkt(train_fit.unionByName(val), n_iter=best), best, losses)
