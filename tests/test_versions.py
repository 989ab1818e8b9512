"""Versions after rollbacks against a log that is replayed entry by entry."""

import random

import pytest

from assayer.operators import versions as V

EVENT, OP, BACK, ASK = "question string, event_id long, at long", "question string, event_id long, op string, at long", "question string, at long, to long", "question string, version int, at long"


def replayed(entries, at):
    """Ids that are active at a position: each rollback restores the set kept at the position it names."""
    kept, now = {-1: frozenset()}, frozenset()
    for place in range(at + 1):
        for kind, value in entries.get(place, []):
            now = now | {value} if kind == "add" else now - {value} if kind == "retract" else kept[value]
        kept[place] = now
    return now


@pytest.mark.parametrize("spans", [100_000, 0])
def test_versions_equal_the_replay(spark, monkeypatch, spans):
    monkeypatch.setattr(V, "BROADCAST_SPANS", spans)
    rng = random.Random(7)
    events, ops, back, ask, logs = [], [], [], [], {}
    for q in ("a", "b"):
        log = {}
        for place in range(200):
            draw = rng.random()
            # an operation names an event of the current version, so a replay of sets says the same
            live = sorted(replayed(log, place - 1)) if place else []
            if place > 5 and draw < 0.06:
                to = rng.randrange(place)
                log[place] = [("back", to)]
                back.append((q, place, to))
            elif live and draw < 0.25:
                e = rng.choice(live)
                log[place] = [("retract", e)]
                ops.append((q, e, "retract", place))
            else:
                log[place] = [("add", place)]
                events.append((q, place, place))
        logs[q] = log
        ask += [(q, v, v) for v in range(0, 200, 7)]
    back += [("a", 50, 60), ("b", 90, 90)]  # to a later position, to its own: none
    s = V.spans(spark.createDataFrame(ask, ASK), spark.createDataFrame(back, BACK))
    got = {}
    for r in V.as_of(spark.createDataFrame(events + [(None, 1, 1), ("a", 999, None)], EVENT), spark.createDataFrame(ops, OP), s).collect():
        got.setdefault((r.question, r.version), []).append(r.event_id)
    for q, v, at in ask:
        assert sorted(got.get((q, v), [])) == sorted(replayed(logs[q], at)), (q, v)
    assert len(back) > 12 and any(r.low is not None for r in s.collect())


def test_retracted_and_restored(spark):
    events = spark.createDataFrame([("a", i, i) for i in range(1, 6)], EVENT)
    ops = spark.createDataFrame([("a", 2, "retract", 6), ("a", 2, "restore", 8), ("a", 3, "retract", 9)], OP)
    back = spark.createDataFrame([("a", 10, 7)], BACK)
    ask = spark.createDataFrame([("a", v, v) for v in (0, 5, 6, 8, 9, 10)], ASK)
    got = {}
    for r in V.as_of(events, ops, V.spans(ask, back)).collect():
        got.setdefault(r.version, set()).add(r.event_id)
    assert got == {5: {1, 2, 3, 4, 5}, 6: {1, 3, 4, 5}, 8: {1, 2, 3, 4, 5}, 9: {1, 2, 4, 5}, 10: {1, 3, 4, 5}}
    assert V.as_of(events.limit(0), ops, V.spans(ask, back.limit(0))).count() == 0
    assert V.spans(ask.limit(0), back).count() == 0
