"""Keyed state over growing input: a stream that stops and goes on tells what one pass over all events does."""

import random

import pandas as pd

from lorewell.operators import knowledge
from lorewell.streaming import ingest, status

EDGES = {"O": "F", "F": "P"}


def events():
    r, out = random.Random(2), []
    for seq in range(400):
        out.append((r.randrange(25), seq, r.choice("OFP"), r.random() < 0.1))
    return out


def run(spark, source, out, state):
    with status.keyed_state(spark):
        stream = status.violations(ingest.source(spark, source, status.EVENTS, files=1), EDGES)
        ingest.append(stream, out, state).awaitTermination()
    return sorted(map(tuple, spark.read.parquet(out).select("node", "seq", "before", "status").collect()))


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    every = events()
    want = knowledge.fsm_violations(spark.createDataFrame(every, status.EVENTS), EDGES)
    want = sorted(map(tuple, want.select("node", "seq", "before", "status").collect()))
    own = spark.conf.get(status.PROVIDER)
    put = lambda rows: spark.createDataFrame(rows, status.EVENTS).coalesce(1).write.mode("append").parquet(source)
    put(every[:100])
    put(every[100:150])
    first = run(spark, source, out, state)
    assert first == [w for w in want if w[1] < 150]
    # a run without new files, then one with a file more
    assert run(spark, source, out, state) == first
    put(every[150:])
    assert run(spark, source, out, state) == want
    # what comes too late tells nothing and changes nothing
    put([(every[-1][0], 3, "P", False), (None, 999, "O", False)])
    assert run(spark, source, out, state) == want
    assert spark.conf.get(status.PROVIDER) == own


class Handle:
    """The state of one group, and how often it was read and written."""

    def __init__(self):
        self.value, self.timers, self.updates = None, [], 0

    def getValueState(self, name, schema):
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    listTimers = lambda self: iter([(t,) for t in self.timers])
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)

    def update(self, value):
        self.value, self.updates = value, self.updates + 1

    def clear(self):
        self.value = None


class Now:
    def __init__(self, ms):
        self.getCurrentProcessingTimeInMs = lambda: ms


def test_nodes_of_a_bucket_share_one_state():
    """Many nodes take one read and one write; numbers beyond 2**53 that differ by one are told apart, and idle nodes are forgotten one by one."""
    machine, handle, big = status.StatusMachine(EDGES, idle_ms=100), Handle(), 10**18
    machine.init(handle)
    told = lambda rows, ms: sorted(map(tuple, pd.concat(list(machine.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["node", "seq", "status", "correction"])]), Now(ms)))).values.tolist()))
    assert told([(n, big, "O", False) for n in range(50)], 1000) == [] and handle.updates == 1 and handle.timers == [1100]
    late = [(7, big, "P", False), (7, big + 1, "P", False), (7, big + 2, "P", True), (7, big + 3, "O", False), (8, big + 1, None, False), (8, big + 2, "F", False)]
    assert told(late[::-1], 1050) == [(7, big + 1, "O", "P"), (7, big + 3, "P", "O"), (8, big + 1, "O", None)]
    list(machine.handleExpiredTimer((0,), Now(1100), None))
    assert handle.value[0] == [7, 8] and handle.timers == [1150]
    assert told([(9, 1, "P", False), (7, 2, "P", False)], 1120) == []
    list(machine.handleExpiredTimer((0,), Now(1220), None))
    assert handle.value is None and handle.timers == []
