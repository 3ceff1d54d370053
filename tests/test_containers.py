"""State containers on shuffled, repeated and late events, against plain windows."""

import random

import numpy as np
import pandas as pd
import pytest

from marketloom.streaming.streams import ContainerProcessor


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Map(dict):
    """A map state that counts what is written."""

    written = 0

    def containsKey(self, k):  # noqa: N802
        return k in self

    def getValue(self, k):  # noqa: N802
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v
        self.written += 1

    def removeKey(self, k):  # noqa: N802
        del self[k]


class Handle:
    def getValueState(self, *_):  # noqa: N802
        return Value()

    def getMapState(self, *_):  # noqa: N802
        return Map()


def run(events, chunks, k=4, span=100, lateness=0):
    p = ContainerProcessor(0.2, k, span, lateness)
    p.init(Handle())
    out = []
    for part in chunks:
        table = pd.DataFrame(part, columns=["event_time_ns", "seq", "price", "quantity"])
        out += list(p.handleInputRows(("A",), iter([table]), None))
    return p, pd.concat(out, ignore_index=True) if out else None


def plain(events, k=4, span=100):
    rows, ema = [], None
    for i, (t, s, x, q) in enumerate(events):
        ema = x if ema is None else ema + 0.2 * (x - ema)
        near = [e for e in events if t - span < e[0] <= t]
        last = [e[2] for e in events[max(0, i - k + 1) : i + 1]]
        volume = sum(e[3] for e in near)
        rows.append((t, s, ema, np.mean(last) if len(last) == k else np.nan, np.std(last, ddof=1) if len(last) == k else np.nan, sum(e[2] for e in near), sum(e[2] * e[3] for e in near) / volume if volume else np.nan, i + 1))
    return pd.DataFrame(rows, columns=["event_time_ns", "seq", "ema", "mean_k", "std_k", "span_sum", "span_vwap", "n"])


def test_a_late_event_doesn_t_make_punctual_ones_wrong():
    """Sums of later rows hold a late event where it belongs."""
    events = [(0, 0, 1.0, 1.0), (50, 1, 2.0, 1.0), (90, 2, 4.0, 1.0), (300, 3, 8.0, 1.0), (60, 4, 16.0, 1.0), (320, 5, 32.0, 1.0), (1000, -1, None, None)]
    _, got = run(events, [events[:4], events[4:5], events[5:]], lateness=400)
    assert dict(zip(got.event_time_ns, got.span_sum)) == {0: 1, 50: 3, 60: 19, 90: 23, 300: 8, 320: 40}
    _, got = run(events, [events[:4], events[4:5], events[5:]])  # too late without a lateness: it changes nothing
    assert dict(zip(got.event_time_ns, got.span_sum)) == {0: 1, 50: 3, 90: 7, 300: 8, 320: 40}


@pytest.mark.parametrize("seed", range(12))
def test_any_order_and_chunking_within_the_lateness(seed):
    draw = random.Random(seed)
    times = sorted(draw.randint(0, 3000) for _ in range(draw.choice((1, 30, 200))))
    events = [(t, i, draw.uniform(1, 9), draw.choice((0.0, 1.0, 2.5))) for i, t in enumerate(times)]
    sent = sorted([(e[0] + draw.randint(0, 150), e) for e in events] + [(e[0] + draw.randint(0, 150), e) for e in events if e[1] % 3 == 0])
    sent = [e for _, e in sent] + [(10_000, -1, None, None)]
    cuts = sorted(draw.randint(0, len(sent)) for _ in range(5))
    chunks = [c for a, b in zip([0, *cuts], [*cuts, len(sent)]) if (c := sent[a:b])]
    p, got = run(events, chunks, lateness=150)
    want = plain(events)
    assert got[["event_time_ns", "seq", "n"]].values.tolist() == want[["event_time_ns", "seq", "n"]].values.tolist()
    for c in ("ema", "mean_k", "std_k", "span_sum", "span_vwap"):
        np.testing.assert_allclose(got[c], want[c], atol=1e-9)
    assert all((k[0] + 1) * p.width > events[-1][0] - 100 for k in p.events)  # nothing is kept that no span reaches


def test_a_micro_batch_writes_its_own_buckets_only():
    events = [(t, t, 1.0, 1.0) for t in range(0, 1000, 2)]
    p, _ = run(events, [events])
    before = p.events.written
    list(p.handleInputRows(("A",), iter([pd.DataFrame([(1001, 1, 2.0, 1.0)], columns=["event_time_ns", "seq", "price", "quantity"])]), None))
    assert p.events.written == before + 1
