"""How often the streams' steps are called and how often they touch their state."""

import pandas as pd

from timeweave.streaming import streams, tracking


def test_a_call_serves_all_stages_of_a_run(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'a' as run_id", "'p' as stage", "timestamp as ts", "1d as current", "1d as total", "'running' as status")
    plan = streams.progress_latest(stream)._jdf.queryExecution().analyzed()
    assert [x.name() for x in _seq(plan.groupingAttributes())] == ["run_id"]


def _seq(x):
    return [x.apply(k) for k in range(x.size())]


class _Value:
    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


class _Handle:
    def __init__(self):
        self.value, self.timers = _Value(), []

    def getValueState(self, *_):
        return self.value

    def registerTimer(self, t):
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


def test_a_call_reads_and_writes_a_source_once():
    """However many tracks and faces the source has; what comes back from the state goes on as if all came at once."""
    box = {"y": 0.1, "w": 0.02, "h": 0.2, "kind": "body", "scene_id": 1}
    rows = [{"source_id": 1, "id": 10 * k + j, "time_us": k * 400_000, "x": 0.09 * j, "embedding": [float(i == j) for i in range(10)], **box} for k in range(6) for j in range(10)]
    handle = _Handle()
    tracker = tracking.Tracker(tracking.Rules())
    tracker.init(handle)
    got = pd.concat([x for part in (rows[:30], rows[30:]) for x in tracker.handleInputRows((1,), iter([pd.DataFrame(part)]), None)])
    assert handle.value.calls == ["get", "update"] * 2 and len(handle.timers) == 1
    want = tracking._frame(tracking.rows_in_order(1, tracking.SourceState({}, {}), pd.DataFrame(rows), tracking.Rules()))
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want)
    assert got["person_id"].nunique() == 10
