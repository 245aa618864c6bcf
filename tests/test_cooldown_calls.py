"""What an entity costs in the cooldown stream: calls to the state, counted with a state in memory."""

import random

from tramline.streaming import streams as R


class Memory:
    """State variables and timers of one entity; counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getValueState(self, name, schema):
        return Variable(self, name)

    getListState = getValueState

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Variable:
    def __init__(self, home, name):
        self.home, self.name = home, name

    def of(self):
        self.home.calls += 1
        return self.home.values.get(self.name)

    def exists(self):
        return self.of() is not None

    def get(self):
        v = self.of()
        return iter(v) if isinstance(v, list) else v

    def put(self, v):
        self.of()
        self.home.values[self.name] = v

    update = put

    def clear(self):
        self.of()
        self.home.values.pop(self.name, None)

    def appendList(self, v):
        self.home.values[self.name] = (self.of() or []) + v

    def appendValue(self, v):
        self.appendList([v])


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_an_entity_costs_few_calls_and_none_that_grow_with_what_waits():
    rnd = random.Random(6)
    rows = sorted((rnd.randrange(3000), rnd.random() < 0.5) for _ in range(400))
    home, out = Memory(), []
    cooldown = R.Cooldown(90)
    cooldown.init(home)

    def wake(now):
        while due := sorted(t for t in home.timers if t <= now):
            home.timers.discard(due[0])
            out.extend(tuple(r) for r in cooldown.handleExpiredTimer(("e",), Clock(now), None))

    # each seventh row comes a batch late, and the watermark lies behind all that can still come
    starts = range(0, 440, 40)
    batches = [[r for k, r in enumerate(rows) if k // 40 + (k % 7 == 0) == i // 40] for i in starts]
    for i, batch in zip(starts, batches, strict=True):
        before = home.calls
        out.extend(cooldown.handleInputRows(("e",), iter([{"ts": t, "on": on} for t, on in batch]), None))
        assert home.calls - before <= 3
        wake(1000 * rows[min(i, 399)][0] - 1)
    before = home.calls
    wake(10**9)
    assert home.calls - before <= 8 * len(batches)
    want, last = [], None
    for t, on in rows:
        fire = on and (last is None or t - last >= 90)
        last = t if fire else last
        want.append(("e", t, fire))
    assert out == want
    assert not home.values and not home.timers
