"""State machines of request control, as steps from (state, event) to (state, result).

The same steps run over a finished table and over a stream, so both give one answer.
Times are seconds; a state is a tuple of numbers and strings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Machine:
    """``state``: its fields as a schema; ``result``: what each event adds; ``step`` makes both.

    ``due`` says when a state changes without an event, and ``tick`` how.
    """

    state: str
    result: str
    start: Callable[[float], tuple]
    step: Callable[[tuple, float, dict], tuple[tuple, tuple]]
    due: Callable[[tuple], float | None] = lambda state: None
    tick: Callable[[tuple], tuple[tuple, tuple]] | None = None


def token_bucket(capacity: float, rate: float) -> Machine:
    """Refill up to the capacity, consume if there is enough; else how long to wait."""

    def step(state: tuple, now: float, event: dict) -> tuple[tuple, tuple]:
        tokens, last = state
        tokens = min(capacity, tokens + max(0.0, now - last) * rate)
        need = float(event["tokens"] or 0)
        if tokens >= need:
            return (tokens - need, now), (True, 0.0, tokens - need)
        return (tokens, now), (False, (need - tokens) / rate, tokens)

    return Machine("tokens double, last double", "admitted boolean, wait_seconds double, left double", lambda now: (float(capacity), now), step)


def admission(requests_per_minute: float, tokens_per_minute: float) -> Machine:
    """A request takes one from the first bucket, then its tokens from the second; the first isn't refunded."""
    requests, tokens = token_bucket(requests_per_minute, requests_per_minute / 60), token_bucket(tokens_per_minute, tokens_per_minute / 60)

    def step(state: tuple, now: float, event: dict) -> tuple[tuple, tuple]:
        first, (ok, wait, _) = requests.step(state[:2], now, {"tokens": 1})
        second = state[2:]
        if ok:
            second, (ok, wait, _) = tokens.step(second, now, event)
        return (*first, *second), (ok, wait)

    fields = "requests double, requests_at double, tokens double, tokens_at double"
    return Machine(fields, "admitted boolean, wait_seconds double", lambda now: (*requests.start(now), *tokens.start(now)), step)


def circuit_breaker(failures: int = 5, recovery: float = 60.0, successes: int = 3) -> Machine:
    """closed until so many failures in a row; open for longer than the recovery time; then half open until so many successes."""

    def step(state: tuple, now: float, event: dict) -> tuple[tuple, tuple]:
        name, failed, good, last = state
        if name == "open":
            if now - last <= recovery:
                return state, ("open", False)
            name, good = "half_open", 0
        if event["success"]:
            if name == "half_open":
                good += 1
                if good >= successes:
                    name, failed = "closed", 0
            else:
                failed = 0
        else:
            failed, last = failed + 1, now
            if name == "half_open" or failed >= failures:
                name = "open"
        return (name, failed, good, last), (name, True)

    def due(state: tuple) -> float | None:
        return state[3] + recovery if state[0] == "open" else None

    def tick(state: tuple) -> tuple[tuple, tuple]:
        return ("half_open", state[1], 0, state[3]), ("half_open", False)

    return Machine("name string, failed int, good int, last double", "breaker string, executed boolean", lambda now: ("closed", 0, 0, 0.0), step, due, tick)


def adaptive_concurrency(initial: int = 15, least: int = 5, most: int = 25, interval: float = 30.0, sample: int = 10) -> Machine:
    """Every interval with enough requests: fewer at a high error rate, more at a low one."""

    def step(state: tuple, now: float, event: dict) -> tuple[tuple, tuple]:
        current, total, errors, since = state
        total, errors = total + 1, errors + (not event["success"])
        if now - since >= interval and total >= sample:
            rate = errors / total
            current = max(least, int(current * 0.7)) if rate > 0.15 else min(most, int(current * 1.3)) if rate < 0.03 else current
            total, errors, since = 0, 0, now
        return (current, total, errors, since), (current,)

    return Machine("current int, total int, errors int, since double", "concurrency int", lambda now: (initial, 0, 0, now), step)


def false_rate(start: float = 0.5) -> Machine:
    """Moving rate of false reports: nine tenths of the old one and a tenth of the new, within 0.1 and 0.9."""

    def step(state: tuple, now: float, event: dict) -> tuple[tuple, tuple]:
        rate = max(0.1, min(0.9, state[0] * 0.9 + (0.0 if event["success"] else 0.1)))
        return (rate,), (rate,)

    return Machine("rate double", "rate double", lambda now: (start,), step)
