"""The registered queries of the library's own operators, and the same in SQL."""

from __future__ import annotations

from .plans import audit, boundaries, commercial, contracts, dialogue, dossier, evidence, folds, goldset, intervals, narrative, questions, rank, recovery, review, signals, speaking, story, streams, timeline, transcript, visual

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for part in (intervals, transcript, evidence, rank, audit, folds, streams, visual, contracts, timeline, commercial, story, review, dossier, signals, narrative, recovery, speaking, questions, boundaries, dialogue, goldset):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
