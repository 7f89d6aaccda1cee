"""Salvage of web archives, interaction of filters and sort-means, each against a brute-force version."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from skein.llm import interaction, sort_means, warc

SHA1 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()


def archive(n=30, seed=1, compressed=True):
    """Bytes of n records, where each begins and what it holds."""
    r, out, starts, payloads = random.Random(seed), b"", [], []
    for i in range(n):
        payload = r.choice([b"", b"<p>%d</p>" % i * r.randint(1, 400), b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n %d" % i, bytes(r.randrange(256) for _ in range(3000))])
        head = b"HTTP/1.1 200 OK\r\n\r\n"
        made = warc.record("response", [("WARC-Record-ID", f"<urn:page:{i}:x>"), ("WARC-Payload-Digest", f"sha1:{SHA1(payload)}"), ("Content-Type", "application/http; msgtype=response")], head + payload) + b"\r\n\r\n"
        starts.append(len(out))
        payloads.append(payload)
        out += warc.gzip_member(made) if compressed else made
    return out, starts, payloads


@pytest.mark.parametrize("compressed", [True, False])
def test_whole_archives_are_read_whole(compressed):
    data, starts, payloads = archive(compressed=compressed)
    rows = list(warc.salvage(data))
    assert [r["kind"] for r in rows] == ["record"] * 30
    assert [r["start"] for r in rows] == starts and [r["payload"] for r in rows] == payloads
    assert [r["end"] for r in rows] == [*starts[1:], len(data)]
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"nothing here")) == [{"kind": "gap", "start": 0, "end": 12, "reason": "no version line"}]


@pytest.mark.parametrize("compressed", [True, False])
def test_records_past_damage_are_recovered(compressed):
    """Every record that no damaged byte touches comes back; gaps and records cover the file once."""
    data, starts, payloads = archive(compressed=compressed)
    ends, r = [*starts[1:], len(data)], random.Random(7)
    for trial in range(60):
        bad, hurt = bytearray(data), set()
        if trial % 3 == 0:  # bytes written over
            for _ in range(r.randint(1, 4)):
                at = r.randrange(len(bad))
                bad[at] ^= r.randint(1, 255)
                hurt.add(next(i for i, e in enumerate(ends) if at < e))
        elif trial % 3 == 1:  # a piece cut out
            at = r.randrange(len(bad))
            size = r.randint(1, 5000)
            hurt = {i for i, (a, e) in enumerate(zip(starts, ends)) if a < at + size and at < e}
            del bad[at : at + size]
        else:  # cut short
            at = r.randrange(1, len(bad))
            hurt = {i for i, e in enumerate(ends) if e > at}
            del bad[at:]
        rows = list(warc.salvage(bytes(bad)))
        found = {x["record_id"]: x["payload"] for x in rows if x["kind"] == "record" and x["record_id"]}
        for i, p in enumerate(payloads):
            if i not in hurt:
                assert found[f"<urn:page:{i}:x>"] == p
        assert all(found[f"<urn:page:{i}:x>"] == p for i, p in enumerate(payloads) if f"<urn:page:{i}:x>" in found)
        covered = sorted((x["start"], x["end"]) for x in rows if x["end"] is not None)
        covered = [k for k, _ in itertools.groupby(covered)]
        assert covered[0][0] == 0 and covered[-1][1] == len(bad) if bad else not covered
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_a_damaged_member_of_many_records_gives_those_before_the_damage():
    plain = archive(40, 3, compressed=False)[0]
    data = bytearray(gzip.compress(plain))
    data[len(data) * 2 // 3] ^= 0x55
    after = warc.gzip_member(warc.record("resource", [("WARC-Record-ID", "<urn:page:last:x>")], b"end") + b"\r\n\r\n")
    rows = list(warc.salvage(bytes(data) + after))
    ids = [x["record_id"] for x in rows if x["kind"] == "record"]
    assert len(ids) > 5 and ids[-1] == "<urn:page:last:x>" and ids[:-1] == [f"<urn:page:{i}:x>" for i in range(len(ids) - 1)]
    assert [(x["start"], x["end"]) for x in rows if x["kind"] == "gap"] == [(0, len(data))]


PAGES = "page_id long, url string, html string, key int, payload string, copy int"


def written(spark, tmp_path, rows, **more):
    warc.write_warc(spark.createDataFrame([(*r, 1, "p", 2) for r in rows], PAGES), str(tmp_path / "w"), **more)
    return warc.read_warc(spark, str(tmp_path / "w"))


@pytest.mark.parametrize("compressed", [True, False])
def test_archives_of_a_table(spark, tmp_path, compressed):
    long = "<p>very long</p>" * 200_000
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (3, "http://a", "x"), (3, "http://a", "x"), (4, None, None), (5, "http://c\r\nd", ""), (None, "http://n", "alone"), (None, "http://n", "ü   \x00"), (9, "u", long), (8, "u", long)]
    read = written(spark, tmp_path, rows, compressed=compressed)
    assert warc.gaps(read).count() == 0
    got = warc.records(read).select(warc.key_of(F.col("record_id")).alias("k"), "record_type", warc.key_of(F.col("refers_to")).alias("to"), "payload_bytes", "payload_digest", "payload", "target_uri", "record_id").collect()
    assert len(got) == len(rows) == len({r.record_id for r in got})
    say = sorted(((r.k, r.record_type, r.to, r.payload_bytes) for r in got), key=repr)
    size = len(long)
    want = [("1", "revisit", "3", 1), ("2", "revisit", "3", 1), ("3", "response", None, 1), ("3", "revisit", "3", 1), ("4", "revisit", "5", 0), ("5", "response", None, 0), (None, "response", None, 5), (None, "response", None, 8), ("9", "response", None, size), ("8", "revisit", "9", size)]
    assert say == sorted(want, key=repr)
    kept = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert kept == {SHA1(t.encode()): t.encode() for t in ("x", "", "alone", "ü   \x00", long)}
    assert {r.payload_digest for r in got} == set(kept)
    assert {r.target_uri for r in got if r.k == "5"} == {"http://c%0D%0Ad"}


def test_archives_are_ordinary_gzip_and_an_empty_table_gives_none(spark, tmp_path):
    written(spark, tmp_path, [(i, f"http://{i}", f"<p>{i % 7}</p>") for i in range(50)])
    text = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "w").glob("part-*")))
    assert len(re.findall(rb"WARC/1\.1\r\n", text)) == 50 and text.endswith(b"\r\n\r\n")
    empty = tmp_path / "none"
    empty.mkdir()
    assert written(spark, empty, []).count() == 0


def test_hot_payloads_equal_those_joined(spark, monkeypatch):
    rows = [(i, f"u{i}", "hot" if i % 3 == 0 else f"t{i // 4}", 1, "p", 2) for i in range(300)]
    pages = spark.createDataFrame(rows, PAGES)
    say = lambda: sorted(((r.key, r.to, r.payload is None) for r in warc.captures(pages, "page_id", "url", "html").collect()))
    one = say()
    monkeypatch.setattr(warc, "HOT", 1)
    assert say() == one and len(one) == 300
    last = {}
    for i, _, html, *_ in rows:
        last[html] = max(i, last.get(html, 0))
    assert one == sorted((i, None if last[h] == i else last[h], last[h] != i) for i, _, h, *_ in rows)


def audit(docs, labels):
    """Every order applied to every row."""
    def fails(i, t, _):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        low = {j for j, u, _ in docs if u == t and i is not None and j is not None and j < i}
        return [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), bool(low)]

    docs = [(i, t or "", lang or "") for i, t, lang in docs]
    marks = [(r, dict(zip("ABCDE", fails(*r)))) for r in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {r[2] for r in docs}:
        mine, shapley = [(r[0], m) for r, m in marks if r[2] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), sum(m[f] for _, m in mine) - len(here), sum(m[f] and sum(m.values()) == 1 for _, m in mine), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
        for (p, o, s), row in out.items():
            if p == part:
                row.append(shapley[o[s - 1]])
    return out


@pytest.mark.parametrize("held", [interaction.HELD, 1])
def test_interaction_equals_brute_force(spark, texts, monkeypatch, held):
    monkeypatch.setattr(interaction, "HELD", held)
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, t, r.choice(["en", "de", None])) for i, t in texts]
    docs += [(100 + i, " ".join(r.choices(words, k=r.choice([20, 150, 600]))) + r.choice(["", " #", " ABCDEFGH" * 40]), r.choice(["en", ""])) for i in range(60)]
    docs += [(200 + i, "the hot text of many rows", r.choice(["en", "fr"])) for i in range(80)]
    docs += [(i, docs[i][1], "en") for i in (3, 3, 30)] + [(None, "the hot text of many rows", "en"), (None, None, None), (300, "very long " * 100_000, "en"), (-5, docs[7][1], "de")]
    r.shuffle(docs)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 290, 2)] + [(2, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, lang string, good int, part string").repartition(5)
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, mask string")
    got = interaction.interaction_audit(frame, marks).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == audit(docs, labels) and len(got) == 600 * len({d[2] or "" for d in docs})
    assert interaction.interaction_audit(frame.limit(0), marks).count() == 0
    assert sum(r.good_lost + r.toxic_lost for r in interaction.interaction_audit(frame, marks.limit(0)).collect()) == 0


def test_texts_of_one_fingerprint_stay_apart():
    c = interaction.Chains()
    met = [x for i, t in enumerate([b"a", b"b", b"a", b"b", b"a"]) for x in c.meet(7, t, 1, 10 - i, {"en": 1})]
    assert sorted(met) == [(8 if i == 8 else i, "en", 17, 1) for i in (8, 9, 10)]
    assert [(e[1][0], e[1][2]) for e in c.drain()] == [(b"a", 6), (b"b", 7)]


def clustered(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    named = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), e) for i, e in kept if i is not None), key=lambda x: x)
    c = [e for _, e in named[:k]]
    near = lambda e: min((sum((x - y) ** 2 for x, y in zip(e, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(e)[1] for _, e in kept]
        c = [[sum(x) // len(mine) for x in zip(*mine)] if (mine := [e for (_, e), a in zip(kept, at) if a == j]) else m for j, m in enumerate(c)]
    last = [(i, *near(e)) for i, e in kept]
    total = {j: sum(d for _, d, a in last if a == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    big = (1 << 63) - 1
    return sorted(((i, a, min(d, big), min(total[a], big), min(sum(total.values()), big), sha[a]) for i, d, a in last), key=repr)


@pytest.mark.parametrize("case", ["spread", "clumps", "ties", "huge"])
def test_sort_means_equals_brute_force(spark, case):
    r = random.Random(5)
    dim = 6
    make = {
        "spread": lambda: [r.uniform(-1, 1) for _ in range(dim)],
        "clumps": lambda: [r.choice([-4, 0, 3]) + r.gauss(0, 0.05) for _ in range(dim)],
        "ties": lambda: [float(r.randint(-1, 1)) for _ in range(dim)],
        "huge": lambda: [r.choice([1e12, 2e12, -3e12, 1e300]) * r.choice([1, 0.5]) for _ in range(dim)] if r.random() < 0.5 else [r.uniform(-9e6, 9e6) for _ in range(dim)],
    }[case]
    rows = [(i, make()) for i in range(300)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (6, make()), (None, make()), (900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 5 + [None]), (904, [math.nan] + [0.0] * 5), (905, [math.inf] + [0.0] * 5)]
    want_rows = [(i, None if e is None else [None if x is None else (max(-(2.0**62), min(2.0**62, 4 * x)) / 4 if math.isfinite(x) else x) for x in e]) for i, e in rows]
    frame = spark.createDataFrame([(*x, 1, "c") for x in rows], "vec_id long, embedding array<double>, cluster int, _k string").repartition(3)
    got = sort_means.cluster(frame, 12, 4, dim, 4)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == clustered(want_rows, 12, 4, dim, 4)
    assert sort_means.cluster(frame.limit(0), 12, 4, dim, 4).collect() == []
    few = frame.filter("vec_id < 3")
    assert sorted(tuple(x) for x in sort_means.cluster(few, 12, 4, dim, 4).collect()) == clustered(want_rows[:3], 12, 4, dim, 4)


def test_a_scan_stops_early_and_loses_no_tie():
    r = np.random.default_rng(1)
    c = np.concatenate([r.integers(-1000, 1000, (30, 3)), np.zeros((3, 3), int)]).astype(np.int64)
    v = np.concatenate([(c[i] + r.integers(-40, 40, (50, 3))) for i in range(33)])
    s = sort_means.Sorted(c.tolist())
    all_ = sort_means.squared(v, c)
    for before in (np.zeros(len(v), np.int64), all_.argmin(axis=1), r.integers(0, 33, len(v))):
        best, least = s.nearest(v, before)
        assert (best == all_.argmin(axis=1)).all() and (least == all_.min(axis=1)).all()
    mine = all_[np.arange(len(v)), all_.argmin(axis=1)]
    scanned = [np.searchsorted(s.gap[a], 4 * d, side="right") for a, d in zip(all_.argmin(axis=1), mine)]
    assert np.mean(scanned) < 8
