"""The state of stream windows costs a few messages, however many cells an asset has."""

import pandas as pd

from millrace.operators.channels import STATISTICS
from millrace.operators.windows import WindowPlan
from millrace.streaming.windows import PACKS, WindowProcessor

HOUR = 3_600_000_000


class Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.held is not None

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value

    def clear(self):
        self.calls += 1
        self.held = None


class Packs(Value):
    put = Value.update

    def appendList(self, values):
        self.calls += 1
        self.held = [*(self.held or []), *values]


class Handle:
    """Stands in for Spark's handle and counts the calls."""

    def __init__(self):
        self.states, self.watermark = [], 0

    def getValueState(self, *_):
        self.states.append(Value())
        return self.states[-1]

    def getListState(self, *_):
        self.states.append(Packs())
        return self.states[-1]

    def listTimers(self):
        return []

    def registerTimer(self, _):
        pass

    def getCurrentWatermarkInMs(self):
        return self.watermark

    calls = property(lambda self: sum(s.calls for s in self.states))


def batch(hours, channels):
    return pd.DataFrame(
        [(h * HOUR + i, c, c, c, float(h + i), 0, 1000.0) for h in hours for i, c in enumerate(channels)],
        columns=["us", "channel", "signal_class", "tag_id", "u", "kind", "interval_ms"],
    )


def test_calls_do_not_grow_with_cells_and_rows_come_out_the_same():
    channels = [f"c{i}" for i in range(20)]
    plan = WindowPlan.of("1h", "1h", "complete")
    got = []
    for parts in ([range(200)], [range(i, i + 5) for i in range(0, 200, 5)]):
        processor, handle = WindowProcessor(plan, channels, {}, list(STATISTICS), []), Handle()
        processor.init(handle)
        for part in parts:
            before = handle.calls
            assert all(frame.empty for frame in processor.handleInputRows(("r", "a"), iter([batch(part, channels)]), handle))
            assert handle.calls - before <= 8
            assert len(processor.packs.held) <= PACKS + 1
        handle.watermark = 190 * HOUR // 1000
        before = handle.calls
        got.append(pd.concat(processor.handleExpiredTimer(("r", "a"), handle, None)))
        assert handle.calls - before <= 8
        # Panes whose windows are open stay.
        assert {place[0] for place in processor._stored()[0]} == set(range(190, 200))
    assert len(got[0]) == 190 and got[0].equals(got[1])
    values = dict(zip([(c, s) for c in channels for s in STATISTICS], got[0]["values"].iloc[7], strict=True))
    assert (values["c3", "mean"], values["c3", "median"], values["c3", "sample_count"], values["c3", "std"]) == (10.0, 10.0, 1.0, 0.0)
