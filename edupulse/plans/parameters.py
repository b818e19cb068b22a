"""Settings that queries and their SQL share."""

from __future__ import annotations

from edupulse.operators.mastery import DEFAULT_BKT, INITIAL_BKT

# Parameter sets (prior, transit, slip, guess) whose losses are compared: the two published ones and some around them.
CANDIDATE_BKT = (DEFAULT_BKT, INITIAL_BKT, (0.5, 0.1, 0.1, 0.2), (0.4, 0.05, 0.2, 0.3), (0.6, 0.02, 0.15, 0.35), (0.7, 0.01, 0.25, 0.4), (0.2, 0.3, 0.05, 0.45))
