"""A processor's rows come in bounded frames, and the state goes on from one to the next."""

import pandas as pd

from marketloom.streaming import streams


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, state):
        self.held = state


def test_features_in_chunks(monkeypatch):
    monkeypatch.setattr(streams, "CHUNK", 7)
    table = pd.DataFrame({"event_time_ns": [k * 37 % 50 for k in range(50)], "seq": range(50), "price": [float(k % 11) for k in range(50)]})
    made = streams.FeatureProcessor(0.2, 5, 0, "drop", 1, False)
    made.value = _Value()
    frames = list(made.handleInputRows(("A",), iter([table[:20], table[20:]]), None))
    assert [len(f) for f in frames] == [7] * 7 + [1]
    state, rows = None, []
    for t, s, x in table.sort_values(["event_time_ns", "seq"]).itertuples(index=False):
        state, out = streams.step(state, t, x, 0.2, 5, 0, "drop", 1, False)
        rows.append(("A", t, s, x, *out))
    got = pd.concat(frames).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, pd.DataFrame(rows, columns=got.columns))
    assert made.value.held == state
