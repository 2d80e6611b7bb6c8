"""Live tracks of detections: each source's frames are matched to its tracks as they arrive, with state that stays bounded.

Detections of a frame go to the source's live tracks one to one so that the sum of scores is largest; a pair may match if gap, size, distance
and box or face overlap allow it, and scores .55 overlap, .25 motion, .05 size and .15 face. Tracks retire when the shot changes or they are
not seen for too long; a face that comes back takes its person up again from a gallery. Of each source the state holds its live tracks, the
gallery (one face for each person, forgotten `gallery_us` after the person was last seen) and three counters. Event-time timers retire
tracks and forget faces of sources that send nothing more.

Frames of a source count in the order of time: rows at or before the last frame that its state has seen are late and come out with
method `late`, no person and no track; they change nothing (those behind the stream's watermark Spark drops before). A null source or time is late too. Boxes without a size never match a track; null faces
and kinds count as missing. Ties of scores go to the first detection (by id) and the smallest person.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DETECTION = ("source_id", "id", "time_us", "scene_id", "x", "y", "w", "h", "kind", "embedding")
OUT = "source_id long, id long, time_us long, person_id long, track_id long, method string, state string, hits int, overlap double, similarity double, retired string"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
_TRACK = "track_id long, scene_id long, time_us long, first_us long, hits int, x double, y double, w double, h double, kind string, vx double, vy double, embedding array<double>"
_TRACK_COLUMNS = [c.split()[0] for c in _TRACK.split(", ")]
_STATE = f"next_person long, next_track long, last_us long, timer_ms long, tracks array<struct<person_id: long, {_TRACK.replace(' ', ': ').replace(',: ', ', ')}>>, gallery array<struct<person_id: long, embedding: array<double>, seen_us: long>>"


# Gaps, gates and weights of the association.
@dataclass(frozen=True)
class Rules:
    gap_us: int = 1 * SECOND
    occlusion_us: int = 2 * SECOND
    least_hits: int = 3
    least_us: int = 1 * SECOND
    least_overlap: float = 0.25
    most_size: float = 3.0
    conflict: float = 0.3
    same_face: float = 0.55
    margin: float = 0.08
    gallery_us: int = 600 * SECOND

    def limit_us(self, hits: int) -> int:
        """How long a track may go unseen: longer once it is well observed."""
        return max(self.gap_us, min(3 * SECOND, self.occlusion_us)) if hits >= self.least_hits else self.gap_us


def best_matching(score: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of the largest sum of scores; a row may stay alone at 0. NaN: the pair can't match. Shortest augmenting paths."""
    n, m = score.shape
    if not n or not m:
        return []
    if n == 1:
        # what the steps below come to: the first of the largest scores, unless alone is better
        j = int(np.where(np.isnan(score[0]), -np.inf, score[0]).argmax())
        return [(0, j)] if score[0, j] >= 0 else []
    # columns m.. are rows' own places to stay alone
    cost = np.hstack([np.where(np.isnan(score), 1e6, -score), np.zeros((n, n))])
    u, v, owner = np.zeros(n + 1), np.zeros(m + n + 1), np.full(m + n + 1, -1)
    for i in range(n):
        owner[-1], at = i, m + n
        least, back, seen = np.full(m + n + 1, np.inf), np.full(m + n + 1, -1), np.zeros(m + n + 1, bool)
        while True:
            seen[at] = True
            row = owner[at]
            reduced = cost[row] - u[row] - v[:-1]
            better = ~seen[:-1] & (reduced < least[:-1])
            least[:-1][better], back[:-1][better] = reduced[better], at
            free = np.where(seen[:-1], np.inf, least[:-1])
            to = int(free.argmin())
            step = free[to]
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            at = to
            if owner[at] < 0:
                break
        while at != m + n:
            owner[at] = owner[back[at]]
            at = back[at]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0 and not math.isnan(score[owner[j], j]))


def overlap(a: dict, b: dict) -> float:
    """Intersection over union of two boxes."""
    w = max(0.0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    h = max(0.0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return w * h / union if union > 0 else 0.0


def _dot(a, b) -> float | None:
    value = float(np.dot(a, b))
    return value if math.isfinite(value) else None


def association(d: dict, t: dict, time_us: int, rules: Rules) -> tuple[float, float, float | None] | None:
    """Score, overlap and face similarity of a detection and a track; None if they can't be the same."""
    gap = time_us - t["time_us"]
    if gap > rules.limit_us(t["hits"]) or (t["kind"] is not None and d["kind"] != t["kind"]) or min(d["w"], d["h"], t["w"], t["h"]) <= 0:
        return None
    similarity = None
    if d["embedding"] is not None and t["embedding"] is not None:
        if len(d["embedding"]) != len(t["embedding"]):
            return None
        similarity = _dot(d["embedding"], t["embedding"])
        if similarity is not None and similarity < rules.conflict:
            return None
    seconds = gap / SECOND
    dx = d["x"] + d["w"] / 2 - (t["x"] + t["w"] / 2 + t["vx"] * seconds)
    dy = d["y"] + d["h"] / 2 - (t["y"] + t["h"] / 2 + t["vy"] * seconds)
    distance, most = math.hypot(dx, dy), min(0.45, max(0.06, t["w"] * 1.5) + 0.18 * seconds)
    size = max(d["w"] / t["w"], t["w"] / d["w"], d["h"] / t["h"], t["h"] / d["h"])
    shared = overlap(d, t)
    strong = similarity is not None and similarity >= rules.same_face
    if distance > most or size > rules.most_size or (shared < rules.least_overlap and not strong):
        return None
    score = 0.55 * shared + 0.25 * max(0.0, 1 - distance / most) + 0.05 / size + 0.15 * max(0.0, similarity or 0.0)
    return score, shared, similarity


@dataclass
class SourceState:
    """What is kept of a source: live tracks and gallery by person, the next numbers, the last frame's time."""

    tracks: dict[int, dict]
    gallery: dict[int, tuple[list[float], int]]
    next_person: int = 1
    next_track: int = 1
    last_us: int | None = None


def _closed(source, person: int, t: dict, reason: str) -> tuple:
    return (source, None, t["time_us"], person, t["track_id"], "retired", "terminated_track", t["hits"], None, None, reason)


def advance(source, state: SourceState, now_us: int, rules: Rules, scene=None, frame: bool = False) -> list[tuple]:
    """Retires tracks that are not seen for too long at now_us or, at a frame, belong to another shot; forgets old faces."""
    out = []
    for person in sorted(state.tracks):
        t = state.tracks[person]
        reason = "visual_shot_cut" if frame and t["scene_id"] != scene else "occlusion_limit" if now_us - t["time_us"] > rules.limit_us(t["hits"]) else None
        if reason:
            out.append(_closed(source, person, state.tracks.pop(person), reason))
    state.gallery = {p: (e, seen) for p, (e, seen) in state.gallery.items() if p in state.tracks or now_us - seen <= rules.gallery_us}
    return out


def one_frame(source, state: SourceState, time_us: int, scene, detections: list[dict], rules: Rules) -> list[tuple]:
    """Matches a frame's detections (by id); changes the state and returns the rows that come out."""
    out = advance(source, state, time_us, rules, scene, frame=True)
    people = sorted(state.tracks)
    pairs = {(i, j): a for i, d in enumerate(detections) for j, p in enumerate(people) if (a := association(d, state.tracks[p], time_us, rules))}
    score = np.full((len(detections), len(people)), np.nan)
    for at, a in pairs.items():
        score[at] = a[0]
    found = {i: (people[j], state.tracks[people[j]]["track_id"], "shot_temporal_fusion", pairs[i, j][1], pairs[i, j][2]) for i, j in best_matching(score)}
    used = {f[0] for f in found.values()}
    for i, d in enumerate(detections):
        if i in found:
            continue
        seen = sorted(((s, p) for p, (e, _) in state.gallery.items() if d["embedding"] is not None and p not in used and p not in state.tracks and len(e) == len(d["embedding"]) and (s := _dot(d["embedding"], e)) is not None), reverse=True)
        if seen and seen[0][0] >= rules.same_face and (len(seen) == 1 or seen[0][0] - seen[1][0] >= rules.margin):
            found[i] = (seen[0][1], state.next_track, "anonymous_face_embedding", None, seen[0][0])
        else:
            found[i] = (state.next_person, state.next_track, "new_identity", None, None)
            state.next_person += 1
        state.next_track += 1
        used.add(found[i][0])
    for i, d in enumerate(detections):
        person, track, method, shared, similarity = found[i]
        old = state.tracks.get(person)
        hits, first = (old["hits"] + 1, old["first_us"]) if old else (1, time_us)
        seconds = (time_us - old["time_us"]) / SECOND if old else 0
        speed = lambda a, s: max(-0.65, min(0.65, (d[a] + d[s] / 2 - old[a] - old[s] / 2) / seconds)) if seconds > 0 else 0.0  # noqa: B023, E731
        state.tracks[person] = {"track_id": track, "scene_id": scene, "time_us": time_us, "first_us": first, "hits": hits, **{k: d[k] for k in ("x", "y", "w", "h", "kind")}, "vx": speed("x", "w"), "vy": speed("y", "h"), "embedding": d["embedding"] if d["embedding"] is not None else old["embedding"] if old else None}
        if d["embedding"] is not None or person in state.gallery:
            state.gallery[person] = (state.gallery.get(person, (d["embedding"], 0))[0], time_us)
        kind = "confirmed_track" if hits >= rules.least_hits and time_us - first >= rules.least_us else "tentative_track"
        out.append((source, d["id"], time_us, person, track, method, kind, hits, shared, similarity, None))
    state.last_us = time_us
    return out


def _plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def rows_in_order(source, state: SourceState, rows: pd.DataFrame, rules: Rules) -> list[tuple]:
    """All of a source's given rows: frames by time, detections by id; late rows as such."""
    out, frames = [], {}
    for r in rows[list(DETECTION)].to_dict("records"):
        time = _plain(r["time_us"])
        if source is None or time is None or (state.last_us is not None and time <= state.last_us):
            out.append((source, _plain(r["id"]), time if time is None else int(time), None, None, "late", None, None, None, None, None))
            continue
        e = r["embedding"]
        d = {k: float(_plain(r[k]) or 0.0) for k in ("x", "y", "w", "h")} | {"id": _plain(r["id"]), "kind": _plain(r["kind"]), "embedding": None if e is None or len(e) == 0 or any(_plain(v) is None for v in e) else [float(v) for v in e]}
        frames.setdefault(int(time), []).append((_plain(r["scene_id"]), d))
    for time in sorted(frames):
        own = sorted(frames[time], key=lambda x: (x[1]["id"] is None, x[1]["id"] or 0))
        scene = max((s for s, _ in own if s is not None), default=None)
        out += one_frame(source, state, time, scene, [d for _, d in own], rules)
    return out


_TYPES = {"long": "Int64", "int": "Int32", "double": "Float64", "string": object}


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows as the output columns, whole numbers kept whole beside nulls."""
    columns = zip(*rows, strict=True) if rows else [()] * len(_COLUMNS)
    kinds = (_TYPES[c.split()[1]] for c in OUT.split(", "))
    return pd.DataFrame({name: pd.Series(list(x), dtype=kind) for name, x, kind in zip(_COLUMNS, columns, kinds, strict=True)})


class Tracker(StatefulProcessor):
    """Keeps each source's SourceState in one value, read and written once a call; one event-time timer a source wakes it when something may expire."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("source", _STATE)

    def _load(self) -> tuple[SourceState, int | None]:
        state, timer = SourceState({}, {}), None
        if (held := self.held.get()) is not None:
            state.next_person, state.next_track, state.last_us, timer, tracks, gallery = held
            state.tracks = {person: dict(zip(_TRACK_COLUMNS, values, strict=True)) for person, *values in tracks}
            state.gallery = {person: (list(embedding), seen) for person, embedding, seen in gallery}
        return state, timer

    def _store(self, state: SourceState, timer: int | None) -> None:
        """Writes the state, and sets the timer to when the next track or face may go."""
        ends = [t["time_us"] + self.rules.limit_us(t["hits"]) for t in state.tracks.values()] or [seen + self.rules.gallery_us for _, seen in state.gallery.values()]
        due = min(ends) // 1000 + 2 if ends else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        tracks = [(person, *(t[k] for k in _TRACK_COLUMNS)) for person, t in state.tracks.items()]
        gallery = [(person, embedding, seen) for person, (embedding, seen) in state.gallery.items()]
        self.held.update((state.next_person, state.next_track, state.last_us, due, tracks, gallery))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, timer = self._load()
        out = rows_in_order(_plain(key[0]), state, pd.concat(list(rows)), self.rules)
        if state.last_us is not None:
            self._store(state, timer)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, timer = self._load()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        out = advance(_plain(key[0]), state, fired * 1000, self.rules)
        self._store(state, None if timer == fired else timer)
        yield _frame(out)

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, rules: Rules = Rules(), late: str = "10 seconds") -> DataFrame:  # noqa: B008
    """A stream of detections (DETECTION, and ts, its event time) to rows of OUT: one for each detection, and one, of method `retired`, for each track that ends.

    The session needs the RocksDB state store (ROCKS as spark.sql.streaming.stateStore.providerClass).
    """
    d = detections.withWatermark("ts", late).groupBy("source_id")
    return d.transformWithStateInPandas(Tracker(rules), OUT, "append", "EventTime")


def track_batch(detections: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The same of all detections at once, without the tracks that still live at the end."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _frame(rows_in_order(_plain(key[0]), SourceState({}, {}), rows, rules))

    return detections.select(*DETECTION).groupBy("source_id").applyInPandas(run, OUT)


def live_after(frames: Iterable[tuple[int, object, list[dict]]], rules: Rules = Rules()) -> SourceState:  # noqa: B008
    """The state that a source's frames (time, scene, detections) leave."""
    state = SourceState({}, {})
    for time, scene, detections in frames:
        one_frame(0, state, time, scene, detections, rules)
    return state
