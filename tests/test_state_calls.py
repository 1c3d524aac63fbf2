"""What a run asks of the state store."""

from collections import Counter

import pandas as pd

from rolecall.streaming.state import KeyedSync


class _Jobs(dict):
    """A map state that counts what is asked of it."""

    def __init__(self):
        super().__init__()
        self.asked = Counter()

    def iterator(self):
        self.asked["iterator"] += 1
        return iter(list(self.items()))

    def getValue(self, key):
        self.asked["getValue"] += 1
        return self.get(key)

    def containsKey(self, key):
        self.asked["containsKey"] += 1
        return key in self

    def updateValue(self, key, value):
        self.asked["updateValue"] += 1
        self[key] = value

    def removeKey(self, key):
        self.asked["removeKey"] += 1
        del self[key]


def _run(sync, rows):
    sync.jobs.asked.clear()
    frame = pd.DataFrame(rows, columns=["source", "source_job_id", "scope", "fingerprint", "ordinal"])
    return sorted(r[:3] for r in pd.concat(sync.handleInputRows(0, iter([frame]), None)).itertuples(index=False, name=None))


def test_covering_run_reads_the_state_in_one_pass():
    sync = KeyedSync("2026-11-01 00:00:00", False, None, None)
    sync.jobs = _Jobs()
    keys = [("s", str(k), "b", "f", k) for k in range(100)]
    cover = [(None, None, "b", None, 0)]
    assert len(_run(sync, keys + cover)) == 100 and sync.jobs.asked == {"iterator": 1, "updateValue": 100}
    changed = [("s", "1", "b", "g", 1), *keys[2:99], ("s", "new", "b", "f", 5)]
    assert _run(sync, changed + cover) == [("insert", "s", "new"), ("miss", "s", "0"), ("miss", "s", "99"), ("update", "s", "1")]
    assert sync.jobs.asked == {"iterator": 1, "updateValue": 4}
    assert _run(sync, [keys[0], *changed] + cover) == [("close", "s", "99"), ("update", "s", "0")] and sync.jobs.asked == {"iterator": 1, "updateValue": 1, "removeKey": 1}
    assert _run(sync, keys[:1]) == [] and sync.jobs.asked == {"getValue": 1}
