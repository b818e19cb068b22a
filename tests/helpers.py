from __future__ import annotations

import random
from datetime import datetime, timedelta

START = datetime(2024, 1, 1)
ATTEMPT_SCHEMA = "student_id long, topic_id string, ts timestamp, event_id long, correct boolean"


def attempts_frame(spark, chains):
    """``chains``: {student: [(topic, correct), ...]}, one minute apart, rows shuffled."""
    rows, event = [], 0
    for student, seq in chains.items():
        for i, (topic, correct) in enumerate(seq):
            rows.append((student, topic, START + timedelta(minutes=i), event, correct))
            event += 1
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, ATTEMPT_SCHEMA)


def random_chains(students=6, length=200, topics=("a", "b"), seed=3, hot=None):
    rng = random.Random(seed)
    chains = {s: [(rng.choice(topics), rng.random() < 0.6) for _ in range(rng.randint(1, length))] for s in range(students)}
    if hot:
        chains[99] = [(rng.choice(topics), rng.random() < 0.7) for _ in range(hot)]
    return chains


def bkt_python(seq, prior=0.5639, transit=0.0274, slip=0.1870, guess=0.3521):
    """(before values, final value) by the plain recurrence."""
    m, before = prior, []
    for ok in seq:
        before.append(m)
        k = m * ((1 - slip) if ok else slip)
        u = (1 - m) * (guess if ok else (1 - guess))
        p = k / (k + u)
        m = min(1.0, max(0.0, p + (1 - p) * transit))
    return before, m
