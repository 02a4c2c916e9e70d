"""The position machine's state, without a stream: how often it is touched, and what comes out of it."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from pairloom.streaming import jobs

T0 = 1_704_067_200_000  # 2024-01-01 in milliseconds
HOUR = 3_600_000


class Store:
    """A state of one symbol in memory that counts its calls."""

    def __init__(self):
        self.calls, self.timers, self.maps, self.value = 0, set(), {}, None

    def getMapState(self, name, *_):  # noqa: N802
        held = self.maps.setdefault(name, {})

        def called(f):
            def one(*a):
                self.calls += 1
                return f(*a)

            return one

        return SimpleNamespace(getValue=called(held.get), containsKey=called(held.__contains__), updateValue=called(held.__setitem__), removeKey=called(held.pop), keys=called(lambda: list(held)))

    def getValueState(self, *_):  # noqa: N802
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


def driven(store, batches, watermark):
    """One batch of the stream: its rows, then the timers that the watermark has passed."""
    machine = jobs.Machine(1.0, 0.5, HOUR // 1000)
    machine.init(store)
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
    found = list(machine.handleInputRows(("s",), iter(batches), times))
    for at in sorted(t for t in store.timers if t <= watermark):
        store.timers.discard(at)
        found += machine.handleExpiredTimer(("s",), times, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
    return found


def cut(rows, size):
    return [rows.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("held", [1_000_000, 700])
def test_state_is_written_by_bucket_not_by_arrow_batch(monkeypatch, held):
    monkeypatch.setattr(jobs, "HELD_ROWS", held)
    rng, hours, n = np.random.default_rng(3), 24, 20_000
    rows = pd.DataFrame({"ts": pd.to_datetime(T0 + np.sort(rng.integers(0, hours * HOUR, n)), unit="ms"), "seq": np.arange(n), "z": np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n))})
    store, middle = Store(), pd.Timestamp(T0 + hours * HOUR // 2, unit="ms")
    first, second = (part.sample(frac=1, random_state=1) for part in (rows[rows.ts < middle], rows[rows.ts >= middle]))
    found = driven(store, cut(first, 100), T0 + 9 * HOUR + 7)  # three hours of the first half wait on
    assert sum(map(len, found)) == (rows.ts < pd.Timestamp(T0 + 9 * HOUR, unit="ms")).sum()
    if held == 1_000_000:
        assert store.calls <= 12 * hours  # 200 Arrow batches of rows of all hours
    found = pd.concat(found + driven(store, cut(second, 100), T0 + 100 * HOUR), ignore_index=True)
    said = pd.Series(np.select([rows.z < -1, rows.z > 1, rows.z.abs() < 0.5], [1, -1, 0], np.nan)).ffill().fillna(0).astype(int)
    assert found.seq.tolist() == rows.seq.tolist() and found.pos.tolist() == said.tolist()
    assert not any(store.maps.values()) and not store.timers
