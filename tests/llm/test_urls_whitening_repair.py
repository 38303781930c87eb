"""URL filtering, whitening and conversation repair against brute force, on ordinary and awkward tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import count

import numpy as np
import pytest
from pyspark.sql import functions as F

CLASH = ("id", "host", "path", "rule", "verdict", "digest", "vector", "dim", "whitened", "place", "copies", "code", "later", "first", "part", "cost")


# ---------------------------------------------------------------- 11
def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def judged(url, rules, default="allow"):
    host, path = parts(url)
    fit = [(len((h + p).encode()), len(h.encode()), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("é.net", "", "block"), ("", "/only", "block"), ("a.b", "/ñ", "block")]
URLS = [None, "", "no scheme", "http://", "http:///only/path", "http://Example.ORG/es/1?q#f", "x://example.org/en/12", "x://example.org/en/2", "x://badexample.org/es/", "x://org", "x://org/", "x://a.com/fr/", "x://com/de/x", "x://.com/de/x", "x://com./de/x", "x://é.net", "x://www.é.net?x", "x://É.net/", "x://a.b/ñandú", "x://a.b/n", "x://u@a.com:80/de/", "a://b://c.org/x", "x://w\nx.org/\ny", "x://a.org/" + "p" * 200_000, "x://a.com/de#x/fr/", "x://" + "s." * 3000 + "com/de/"]


@pytest.mark.parametrize("bits, shard_bytes", [(64, 1 << 20), (64, 60), (2, 1 << 20)])
def test_urls(spark, tmp_path, bits, shard_bytes):
    from plumbline.llm.urls import judge, write_array

    array = write_array(spark.createDataFrame([*RULES, RULES[0], ("EXAMPLE.org", "/es/", "allow"), (None, "/", "block"), ("x", "/", None)], "host string, path string, verdict string"), f"file://{tmp_path}/a", shard_bytes, bits)
    assert (array.shards > 3) == (shard_bytes == 60)
    urls = [*URLS, URLS[5]]
    pages = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({c: F.lit("x") for c in CLASH})
    got = Counter(tuple(r) for r in judge(pages, array).collect())
    assert got == Counter((i if i else None, *judged(u, RULES)) for i, u in enumerate(urls))
    assert judge(pages.limit(0), array).count() == 0
    none = write_array(spark.createDataFrame([], "host string, path string, verdict string"), f"file://{tmp_path}/b")
    assert {r["verdict"] for r in judge(pages, none, default="block").collect()} == {"block"}


def test_many_rules(spark, tmp_path):
    from plumbline.llm.urls import judge, write_array

    rng = random.Random(3)
    name = lambda k: "".join(rng.choice("abc") for _ in range(k))
    rules = {(".".join(name(rng.randint(1, 2)) for _ in range(rng.randint(1, 3))), "/" + name(rng.randint(0, 3))): rng.choice(["allow", "block"]) for _ in range(3000)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{'.'.join(name(rng.randint(1, 2)) for _ in range(rng.randint(1, 4)))}/{name(rng.randint(0, 5))}" for _ in range(400)]
    array = write_array(spark.createDataFrame(rules, "host string, path string, verdict string"), f"file://{tmp_path}/m", shard_bytes=20_000)
    assert array.entries > 3000 // 2 and array.shards > 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r["page_id"]: tuple(r)[1:] for r in judge(pages, array).collect()} == {i: judged(u, rules) for i, u in enumerate(urls)}


# ---------------------------------------------------------------- 12
def quantised(rows):
    out = []
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            out.append((i, [int(np.floor(1024 * float(np.float32(x)))) + 100000 for x in v]))
    return out


def test_whitening(spark):
    from plumbline.llm.whitening import report

    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 50
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [None] + rows[0][1][1:]), (903, [float("nan")] + rows[0][1][1:]), (904, [float("inf")] * 12), (905, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in CLASH}).repartition(3)
    kept = [(i, x) for i, x in quantised(rows) if len(x) == 12]
    n = len(kept)
    sums = [sum(x[j] for _, x in kept) for j in range(12)]
    # The covariance in whole numbers: n * n * n * V.
    exact = [[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in kept) for b in range(12)] for a in range(12)]
    trace = sum(exact[a][a] for a in range(12))
    got = report(table).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    assert all(r["identity_error"] < 1e-12 for r in got)
    values, vectors = np.linalg.eigh(np.array([[float(Fraction(c, n**3)) for c in line] for line in exact]))
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = {}
    by = Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept)
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == by
    want = {}
    for i, x in kept:
        off = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        want.setdefault(i, []).append(off @ vectors[:, :8] / np.sqrt(values[:8]))
    for r in got:
        k = r["component"] - 1
        assert abs(r["explained"] / (values[k] * n**3 / float(trace)) - 1) < 1e-9
        other = want[r["vec_id"]][0][k]
        sign = signs.setdefault(k, 1 if r["whitened"] * other > 0 else -1)
        assert abs(r["whitened"] * sign - other) < 1e-8 * (1 + abs(other))


def test_components_are_exact_to_double_precision():
    from plumbline.llm.whitening import components

    rng = np.random.default_rng(1)
    a = rng.integers(-1000, 1000, size=(20, 9))
    exact = [[Fraction(int(a[:, i] @ a[:, j])) / 7 for j in range(9)] for i in range(9)]
    high = np.array([[float(x) for x in line] for line in exact])
    low = np.array([[float(x - Fraction(float(x))) for x in line] for line in exact])
    values, vectors = components(high, low)
    for k in range(9):  # residuals in whole fractions
        v = [Fraction(float(x)) for x in vectors[:, k]]
        off = [sum(exact[i][j] * v[j] for j in range(9)) - Fraction(float(values[k])) * v[i] for i in range(9)]
        assert max(abs(float(x)) for x in off) < 4e-16 * values[0]
        assert abs(float(sum(x * x for x in v)) - 1) < 4e-16
    assert list(values) == sorted(values, reverse=True)


def test_products_keep_what_doubles_lose():
    from plumbline.llm.whitening import Products, centring

    rng = np.random.default_rng(2)
    x = np.concatenate((rng.integers(0, 3, size=(1500, 3)), [[1 << 40, 5, -(1 << 30)]])) + (1 << 45)
    n, sums = len(x), [int(s) for s in x.astype(object).sum(axis=0)]
    centre, held = centring(n, sums), Products(3)
    for i in range(0, n, 1024):
        held.add(*centre(x[i : i + 1024]))
    for a in range(3):
        for b in range(3):
            exact = Fraction(sum((n * int(r[a]) - sums[a]) * (n * int(r[b]) - sums[b]) for r in x), n * n)
            got = Fraction(float(held.high[a, b])) + Fraction(float(held.low[a, b]))
            size = Fraction(sum(abs(n * int(r[a]) - sums[a]) * abs(n * int(r[b]) - sums[b]) for r in x), n * n)
            assert abs(got - exact) < size / (1 << 90)


def test_whitening_of_few_or_equal_vectors(spark):
    from plumbline.llm.whitening import report

    kind = "vec_id long, embedding array<float>"
    make = lambda rows: report(spark.createDataFrame(rows, kind)).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [1.0, 2.0])]) == [] and make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    two = make([(1, [0.0, 0.0]), (2, [1.0, 1.0])])  # one direction
    assert [(r["vec_id"], r["component"]) for r in sorted(two)] == [(1, 1), (2, 1)]
    assert sorted(round(r["whitened"], 12) for r in two) == [-1, 1] and two[0]["explained"] == pytest.approx(1)
    far = make([(i, [float(i % 2) * 2**40, float(i)]) for i in range(4)])  # beyond a long
    assert {r["deviation"] for r in far} == {None}


# ---------------------------------------------------------------- 13
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FILL = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}\n{r[2]}".encode()).digest()))


def plain(rows):
    """The contract by a search of (cost, letters) in order, one path at a time."""
    rows = damage(rows)
    seen, faults = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done, tick = [(0, "", 0, 0, ())], set(), count()
    while True:
        cost, letters, i, q, lines = heapq.heappop(heap)[:5]
        if i == len(rows) and q in (0, 3):
            break
        if (i, q) in done:
            continue
        done.add((i, q))
        push = lambda c, a, j, p, new: heapq.heappush(heap, (cost + c, letters + a, j, p, lines + new, next(tick)))
        name, to = FILL[q]
        push(5, "I", i, to, (f"{name}:",))
        if i < len(rows):
            _, role, text = rows[i]
            push(2, "D", i + 1, q, ())
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                if (q, role[:1]) in NEXT:
                    push(more, "K", i + 1, NEXT[q, role[:1]], (f"{role}:{text}",))
                push(1 + more, "R", i + 1, to, (f"{name}:{text}",))
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = Counter(faults)
    return (gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(rng, conv, n):
    role = lambda: rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "ua"])
    text = lambda: rng.choice(["Yes.", "No!", "cut", "", " \n", None, "é?", f"t{rng.randrange(9)}.", "x. \t"])
    return [(conv, rng.choice([None, *range(2 * n)]), role(), text()) for _ in range(n)]


def test_repair(spark, monkeypatch):
    from plumbline.llm import repair

    rng = random.Random(11)
    convs = {i: made(rng, i, rng.randint(1, 9)) for i in range(150)} | {None: made(rng, None, 7), 500: made(rng, 500, 60) * 2, 501: [(501, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(300)]}
    convs[502] = [(502, 3, "user", "long " * 100_000 + ".")]
    dropped = next(i for i in range(600, 900) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    convs[dropped] = [(dropped, 0, "user", "gone.")]
    rows = [r for c in convs.values() for r in c]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in CLASH})
    for block in (1024, 4):
        monkeypatch.setattr(repair, "BLOCK", block)
        got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(repair.damaged(table)).collect()}
        assert got == {c: plain(r) for c, r in convs.items()}
        monkeypatch.undo()
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert repair.report(repair.damaged(table.limit(0))).count() == 0


def test_cheapest_in_blocks(monkeypatch):
    from plumbline.llm import repair

    rng = random.Random(5)
    for _ in range(200):
        rows = bytes(rng.randrange(4) | rng.choice([0, 0, 0, repair.DELETE, repair.TRUNCATED]) for _ in range(rng.randint(0, 40)))
        found = set()
        for block in (1, 3, 8, 1024):
            monkeypatch.setattr(repair, "BLOCK", block)
            found.add(repair.Edits().cheapest(rows))
        assert len(found) == 1


def test_repaired_rows(spark):
    from plumbline.llm.repair import audit, prepared, repaired

    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Hi."), (1, 2, "user", "A question?"), (1, 3, "assistant", "An answ")]
    table = prepared(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    out = [tuple(r)[1:] for r in repaired(table, audit(table)).collect()]
    assert out == [(0, "user", "Hello."), (1, "assistant", "Hi.")]
