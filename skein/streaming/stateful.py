"""Operators that depend on the order of a key's rows: result cache, reply streams, throttle, entitlements.

Each is a fold: a state and a step from the state and one row to output rows. The same fold runs over a table (rows dealt by
key, sorted inside the task, one state held at a time: a key's rows are never gathered) and over a stream (the state kept by
Structured Streaming as one JSON text a key, so that a restart from the checkpoint goes on where the last batch ended)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Entries, seconds and cosine of the result cache; seconds between two emissions.
CACHE_ENTRIES, CACHE_SECONDS, CACHE_COSINE, EVERY = 20, 300.0, 0.95, 1.0


class Fold:
    """columns: what a row must have beside the key. out: the schema of what a step gives, without the key."""

    columns: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    out: str = ""

    def start(self) -> dict[str, Any]:
        raise NotImplementedError

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        raise NotImplementedError

    def finish(self, state: dict) -> Iterator[tuple]:
        """What is still owed when a key's rows have ended, or its timer has gone off."""
        return iter(())

    def due(self, state: dict) -> float | None:
        """The event time in seconds at which finish() is due, if any."""
        return None


def plain(value):
    """numpy arrays and numbers as Python's."""
    return value.tolist() if hasattr(value, "tolist") else value


def as_table(rows: DataFrame, key: str, fold: Fold) -> DataFrame:
    """key and fold.out of rows (key, *fold.columns), each key's rows in fold.order. A null key is a key."""
    names = [key, *fold.columns]
    key_type = rows.schema[key].dataType.simpleString()
    cols = [key, *(c.split()[0] for c in fold.out.split(", "))]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        state, at = None, object()
        for b in batches:
            out = []
            for row in zip(*(b[c].astype(object).where(b[c].notna(), None) for c in names)):
                if state is None or row[0] != at:
                    if state is not None:
                        out += [(at, *x) for x in fold.finish(state)]
                    state, at = fold.start(), row[0]
                out += [(at, *x) for x in fold.step(state, {c: plain(v) for c, v in zip(fold.columns, row[1:])})]
            yield pd.DataFrame(out, columns=cols)
        if state is not None:
            yield pd.DataFrame([(at, *x) for x in fold.finish(state)], columns=cols)

    dealt = rows.select(*names).repartition(key).sortWithinPartitions(key, *fold.order)
    return dealt.mapInPandas(run, f"{key} {key_type}, {fold.out}")


def as_stream(rows: DataFrame, key: str, fold: Fold) -> DataFrame:
    """The same over a stream: rows of one batch in fold.order, batches as they come. A fold with due() needs a watermark on
    rows, which moves its timers."""
    key_type = rows.schema[key].dataType.simpleString()
    cols = [key, *(c.split()[0] for c in fold.out.split(", "))]

    def run(group: tuple, frames: Iterator, held: GroupState) -> Iterator:
        import pandas as pd

        state = json.loads(held.get[0]) if held.exists else fold.start()
        if held.hasTimedOut:
            out = list(fold.finish(state))
        else:
            b = pd.concat(list(frames)).sort_values(list(fold.order), kind="stable")
            out = []
            for row in zip(*(b[c].astype(object).where(b[c].notna(), None) for c in fold.columns)):
                out += fold.step(state, {c: plain(v) for c, v in zip(fold.columns, row)})
        held.update((json.dumps(state),))
        due = fold.due(state)
        if due is not None:
            held.setTimeoutTimestamp(max(int(due * 1000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(group[0], *x) for x in out], columns=cols)

    timer = GroupStateTimeout.EventTimeTimeout if type(fold).due is not Fold.due else GroupStateTimeout.NoTimeout
    named = rows.groupBy(key)
    return named.applyInPandasWithState(run, f"{key} {key_type}, {fold.out}", "state string", "append", timer)


class QueryCache(Fold):
    """Result cache of one container. Rows are of kind ask, put or clear, at `ts` seconds.

    ask: the first entry not older than `seconds` whose question has a cosine above `cosine` answers with its results, cut at
    k (and short, where they were stored for a smaller k). Where none does and the row brings results, they are put. put:
    entries older than `seconds` go, the new one comes last, the first goes beyond `entries`. clear (any write to the
    container): all go. Questions of another size or of length 0 match nothing; a null k means all."""

    columns = ("ts", "id", "kind", "embedding", "results", "k")
    order = ("ts", "id")
    out = "id long, hit boolean, entry long, results array<long>, entries int"

    def __init__(self, entries: int = CACHE_ENTRIES, seconds: float = CACHE_SECONDS, cosine: float = CACHE_COSINE):
        self.entries, self.seconds, self.cosine = entries, seconds, cosine

    def start(self):
        return {"held": []}

    def like(self, a: list[float] | None, b: list[float]) -> bool:
        if not a or len(a) != len(b):
            return False
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return size > 0 and sum(x * y for x, y in zip(a, b)) / size > self.cosine

    def step(self, state, row):
        held, now = state["held"], row["ts"]
        found = None
        if row["kind"] == "clear":
            held.clear()
        elif row["kind"] == "ask":
            found = next((e for e in held if now - e[1] <= self.seconds and self.like(row["embedding"], e[2])), None)
        if row["kind"] == "put" or row["kind"] == "ask" and found is None and row["results"] is not None and row["embedding"]:
            held[:] = [e for e in held if now - e[1] <= self.seconds]
            held.append([row["id"], now, row["embedding"], row["results"] or []])
            del held[: max(0, len(held) - self.entries)]
        if row["kind"] == "ask":
            results = found[3] if found else row["results"]
            cut = results if results is None or row["k"] is None else results[: int(row["k"])]
            yield row["id"], found is not None, found[0] if found else None, cut, len(held)


class ReplyStream(Fold):
    """Server-sent events of a model's reply, cut anywhere: pieces of text `data` at `ts` seconds, in the order of `seq`.

    Lines end at LF, CR or CR LF, also across pieces. Empty lines and those that begin with a colon are skipped; a line of
    `data:` and [DONE] ends the reply and what follows is ignored. What stands behind `data:` is an object with
    choices[0].delta.content (more text), choices[0].message.content, choices[0].text or content (the whole text so far, of
    which what goes beyond the common prefix is new), or else is more text as it is. For each piece with new text, and at the
    end, a row: the new text, the whole text's length, words so far (by spaces, in each addition), seconds from the first
    piece to the first text, and whether it is the end. A repeated piece (seq not above the last) is ignored."""

    columns = ("seq", "ts", "data")
    order = ("seq",)
    out = "seq long, text string, n_chars long, n_tokens long, ttft double, is_final boolean"

    def start(self):
        return {"rest": "", "text": "", "tokens": 0, "began": None, "first": None, "done": False, "seq": None}

    def addition(self, state: dict, line: str) -> str:
        payload = line.partition("data:")[2].strip(" \t")
        try:
            said = json.loads(payload)
        except ValueError:
            said = None
        if not isinstance(said, dict):
            state["text"] += payload
            return payload
        delta = whole = None
        get = lambda x, k: x.get(k) if isinstance(x, dict) and isinstance(x.get(k), str) else None
        if isinstance(said.get("choices"), list) and said["choices"] and all(isinstance(c, dict) for c in said["choices"]):
            first = said["choices"][0]
            delta = get(first.get("delta"), "content")
            whole = get(first.get("message"), "content")
            whole = get(first, "text") if whole is None else whole
        else:
            whole = get(said, "content")
        if delta is not None:
            state["text"] += delta
            return delta
        if whole is None:
            return ""
        same = next((i for i, (x, y) in enumerate(zip(state["text"], whole)) if x != y), min(len(state["text"]), len(whole)))
        state["text"] = whole
        return whole[same:]

    def step(self, state, row):
        if state["done"] or state["seq"] is not None and row["seq"] <= state["seq"]:
            return
        state["seq"] = row["seq"]
        state["began"] = row["ts"] if state["began"] is None else state["began"]
        text = state["rest"] + (row["data"] or "")
        held = text.endswith("\r")  # its LF may be in the next piece
        lines = text[: len(text) - held].replace("\r\n", "\n").replace("\r", "\n").split("\n")
        state["rest"] = lines.pop() + "\r" * held
        new = []
        for line in lines:
            if not line or line.startswith(":") or "data:" not in line:
                continue
            if line in ("data: [DONE]", "data:[DONE]"):
                state["done"] = True
                break
            new.append(self.addition(state, line))
            state["tokens"] += len([w for w in new[-1].split(" ") if w])
        said = "".join(new)
        if said and state["first"] is None:
            state["first"] = row["ts"] - state["began"]
        if said or state["done"]:
            yield row["seq"], said, len(state["text"]), state["tokens"], state["first"], state["done"]


class Throttle(Fold):
    """At most one emission in `every` seconds of event time, and the last value is not lost.

    A row is emitted at its own time if `every` seconds have passed since the last emission, else it waits in place of the
    one that waited; what waits is emitted when they have passed, whether a further row comes or not. A row older than the
    last emission waits too."""

    columns = ("ts", "id", "value")
    order = ("ts", "id")
    out = "at double, id long, value double, waited boolean"

    def __init__(self, every: float = EVERY):
        self.every = every

    def start(self):
        return {"last": None, "wait": None}

    def finish(self, state):
        if state["wait"] is not None:
            state["last"] += self.every
            id_, value = state["wait"]
            state["wait"] = None
            yield state["last"], id_, value, True

    def due(self, state):
        return None if state["wait"] is None else state["last"] + self.every

    def step(self, state, row):
        if state["last"] is not None and row["ts"] >= state["last"] + self.every:
            yield from self.finish(state)
        if state["last"] is None or row["ts"] >= state["last"] + self.every:
            state["last"] = row["ts"]
            yield row["ts"], row["id"], row["value"], False
        else:
            state["wait"] = [row["id"], row["value"]]


#: Ranks of tiers, their document and library limits, documents of a pack and packs that count.
TIERS = {"free": (0, 10, 1), "starter": (1, 40, 3), "pro": (2, 1000, 10), "lifetime": (3, 1000, 10)}
PACK, PACK_DOCUMENTS, MOST_PACKS = "pack", 25, 3


class Entitlements(Fold):
    """Billing events of a user: purchases and revocations of a tier or of a document pack, in the order they come.

    A purchase raises the tier to the product's if that ranks higher; a revocation of the active tier's product falls back
    to free. A pack is added once for each transaction, unless MOST_PACKS unexpired ones are held; its revocation removes
    the pack of the transaction, or where there is none the first unexpired one. Failed, cancelled and pending events change
    nothing. Late and repeated deliveries: a purchase of a transaction that was revoked before is ignored, and so is a
    transaction that was applied before; a revocation counts once. Packs end at `expires` seconds (null: never)."""

    columns = ("ts", "id", "kind", "product", "transaction", "expires")
    order = ("ts", "id")
    out = "id long, tier string, packs int, documents long, libraries long, status string"

    def start(self):
        return {"tier": "free", "packs": [], "seen": [], "revoked": []}

    def step(self, state, row):
        kind, product, number, now = row["kind"], row["product"], row["transaction"], row["ts"]
        packs, status = state["packs"], "ignored"
        live = lambda p: p[1] is None or p[1] > now
        packs[:] = [p for p in packs if live(p)]
        if kind == "purchase" and number not in state["seen"] and number not in state["revoked"]:
            state["seen"].append(number)
            if product in TIERS and TIERS[product][0] > TIERS[state["tier"]][0]:
                state["tier"], status = product, "upgraded"
            elif product == PACK:
                if len(packs) < MOST_PACKS:
                    packs.append([number, row["expires"]])
                status = "pack" if packs and packs[-1][0] == number else "cap reached"
        elif kind == "revoke" and number not in state["revoked"]:
            state["revoked"].append(number)
            if product == state["tier"] and product != "free":
                state["tier"], status = "free", "revoked"
            elif product == PACK and packs:
                del packs[next((i for i, p in enumerate(packs) if p[0] == number), 0)]
                status = "pack removed"
        _, documents, libraries = TIERS[state["tier"]]
        yield row["id"], state["tier"], len(packs), documents + PACK_DOCUMENTS * len(packs), libraries, status


class Consent(Fold):
    """Consent of a user to send data to a provider. Rows of kind decide (value allow, once, deny or reset) and send.

    A send goes out by a remembered or session grant, is denied, or asks; a new send while one asks denies the older one. The
    decision answers the one that asks: once grants it and the rest of the session, which `new_session` ends."""

    columns = ("ts", "id", "kind", "value")
    order = ("ts", "id")
    out = "id long, outcome string, answers long"

    def start(self):
        return {"state": "ask", "session": False, "pending": None}

    def step(self, state, row):
        if row["kind"] == "new_session":
            state["session"], state["pending"] = False, None
        elif row["kind"] == "send":
            if state["session"]:
                yield row["id"], "session", None
            elif state["state"] == "allow":
                yield row["id"], "remembered", None
            elif state["state"] == "deny":
                yield row["id"], "denied", None
            else:
                if state["pending"] is not None:
                    yield row["id"], "denied", state["pending"]
                state["pending"] = row["id"]
                yield row["id"], "asked", None
        elif row["kind"] == "decide":
            if row["value"] in ("allow", "deny"):
                state["state"] = row["value"]
            elif row["value"] == "once":
                state["session"] = True
            elif row["value"] == "reset":
                state["state"], state["session"] = "ask", False
            if state["pending"] is not None and row["value"] != "reset":
                said = {"allow": "remembered", "once": "session", "deny": "denied"}.get(row["value"], "denied")
                yield row["id"], said, state["pending"]
                state["pending"] = None
