"""The state machines of the market: candidates after a departure, second looks, roster streaks, shares of errors."""

from __future__ import annotations

from .ordered import Machine

HOUR = 3_600_000

# States of a candidate, and what the result of a probe makes of it: state, outcome, hours until the next check for the first, second ...
# probe (the last for all further ones), and the outcome and hours once these are used up.
LIVE = ("exited", "probing", "parked-watch", "detected", "transferring")
ENDS = ("resolved", "abandoned", "expired")
LADDER = (168, 552, 720, 720)
PROBES = {
    "transfer": ("transferring", "registrar-transfer", (6,), ("registrar-transfer", 6)),
    "probable": ("detected", "likely-sale", (24,) * 7, ("likely-sale", 72)),
    "suspected": ("probing", "unconfirmed-move", (24, 72, 168, 336), ("unconfirmed-move", 720)),
    "expiration": ("parked-watch", "expiration", (), ("expiration", 1080)),
    "hold": ("parked-watch", "registry-hold", (), ("registry-hold", 1080)),
    "parking": ("parked-watch", None, LADDER, ("sale-or-parking-destination", 720)),
    "gone": ("dropped", "dropped", (), ("dropped", None)),
    "nothing": ("probing", None, LADDER, ("no-evidence", None)),
}


class Lifecycle(Machine):
    """A candidate's state. ``departure`` starts it or starts it anew, from any state; a follow-up ``movement`` reopens a probing or parked one and makes
    any live one due; probes (see ``PROBES``) and decisions (``ENDS``) count for live ones only. Once a check is due and nothing has come, ``check`` is written."""

    state = "state string, probes int, outcome string"
    output = "fact string, state string, probes int, outcome string, next_us long"

    def row(self, held, due, ms, fact, detail):
        state, probes, outcome = held or (None, 0, None)
        if fact == "departure":
            state, outcome, due = "exited", None, ms
        elif state not in LIVE or fact not in ("movement", *ENDS, *PROBES):
            return held, due, None
        elif fact == "movement":
            state, due = ("exited" if state in ("probing", "parked-watch") else state), ms
        elif fact in ENDS:
            state, due = fact, None
        else:
            state, outcome, hours, (last_outcome, last_hours) = PROBES[fact]
            wait = hours[probes] if probes < len(hours) else last_hours
            outcome = outcome if probes < len(hours) else last_outcome
            probes += 1
            due = None if wait is None else ms + wait * HOUR
        return (state, probes, outcome), due, (fact, state, probes, outcome, None if due is None else due * 1000)

    def due(self, held, ms):
        state, probes, outcome = held
        return held, None, ("check", state, probes, outcome, None)


class SecondLook(Machine):
    """A first look at a name that finds nothing built is repeated once: ``recheck`` is written after ``minutes``, unless a look comes before. What is
    found is written once for each name: at the first look if it is built, else at the second."""

    state = "looks int"
    output = "what string, looks int"

    def __init__(self, minutes: int = 20):
        self.wait = minutes * 60_000

    def row(self, held, due, ms, fact, detail):
        looks = held[0] if held else 0
        if looks == 0 and fact == "built":
            return (2,), None, (fact, 1)
        if looks == 0:
            return (1,), ms + self.wait, None
        if looks == 1:
            return (2,), None, (fact, 2)
        return held, due, None

    def due(self, held, ms):
        return held, None, ("recheck", 1)


class Roster(Machine):
    """A name's miss streak: after ``retire_after`` in a row it is retired and not looked at until ``fresh`` evidence; ``unknown`` changes nothing
    and carries the last hosts forward; ``taken`` ends a streak. ``detail`` has the hosts that were seen."""

    state = "misses int, hosts string"
    output = "fact string, misses int, retired boolean, hosts string"

    def __init__(self, retire_after: int = 3):
        self.most = retire_after

    def row(self, held, due, ms, fact, detail):
        misses, hosts = held or (0, None)
        if misses >= self.most and fact != "fresh":
            return held, None, None
        if fact == "taken":
            misses, hosts = 0, detail
        elif fact == "missing":
            misses, hosts = misses + 1, None
        elif fact == "fresh" and (held is None or misses >= self.most):
            misses, hosts = 0, None
        return (misses, hosts), None, (fact, misses, misses >= self.most, hosts)


class ErrorShare(Machine):
    """The share of errors among the last ``rows`` of a key, and the number of parallel requests: a whole window with a larger share than
    ``threshold`` halves it, down to ``floor``, and starts the window that watches it anew."""

    state = "last string, watched string, limit int"
    output = "error_share double, limit int"

    def __init__(self, rows: int = 1000, threshold: float = 0.3, limit: int = 48, floor: int = 4):
        self.rows, self.threshold, self.limit, self.floor = rows, threshold, limit, floor

    def row(self, held, due, ms, fact, detail):
        last, watched, limit = held or ("", "", self.limit)
        bit = "1" if fact == "error" else "0"
        last, watched = (last + bit)[-self.rows :], (watched + bit)[-self.rows :]
        if len(watched) == self.rows and limit > self.floor and watched.count("1") / self.rows > self.threshold:
            limit, watched = max(self.floor, limit // 2), ""
        return (last, watched, limit), None, (last.count("1") / len(last), limit)
