"""Credential spans against plain searching of every text."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from thresher.llm import credentials

SCHEMA = "doc_id long, text string"
CLASHING = ["row", "kind", "start", "end", "bin", "of", "part", "found", "base", "before", "place", "step", "assign", "key", "id"]
SOLID = credentials.KINDS[:3]


def search(text):
    found = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [("assign", *m.span())] if len(m[2]) >= 6 else []
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        found += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    for kind in ("id", "key", "endpoint"):
        for m in re.finditer(credentials.PATTERNS[kind], text):
            good = {"id": lambda: len(m[2]) >= 3, "key": lambda: all(re.search(p, m[0]) for p in ("[a-z]", "[A-Z]", "[0-9]")), "endpoint": lambda: True}[kind]()
            found += [(kind, *m.span())] if good else []
    return found


def reported(found):
    out = [f for f in found if f[0] in SOLID]
    for kind, s, e in found:
        if kind in SOLID or any(k in SOLID and a < e and b > s for k, a, b in found):
            continue
        near = {k for k, a, b in found if a < e + 200 and b > s - 200}
        secret = bool(near & {"assign", "hex"})
        if {"id": secret or {"key", "endpoint"} <= near, "key": "access" in near or {"id", "endpoint"} <= near,
                "endpoint": ("access" in near and (secret or "key" in near)) or ("id" in near and secret)}[kind]:
            out.append((kind, s, e))
    return sorted(out, key=lambda f: (f[1], credentials.KINDS.index(f[0])))


def line(found):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def slow(rows):
    out = []
    for i, text in rows:
        found = reported(search(text or ""))
        base = [f for f in found if f[0] in SOLID]
        out.append((i, *[sum(k == x for x, _, _ in base) for k in SOLID], hashlib.sha256(line(base).encode()).hexdigest(), line(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(8)
    key = lambda n, letters: "".join(r.choices(letters, k=n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    parts = ["token: token = abcdefgh", "PassWord='x1y2z3'", "api_key==abcdef", "APIKEY : \"a.b-c_d\"", "ſecret=abcdefgh", "toKen=abcdefgh", "secret=short", "AKIA" + "A1" * 8, "AKIAAKIA1", "AKIA" + "Z" * 15,
             key(23, "0123456789abcdef"), key(24, "0123456789abcdef"), "f" * 90, "user=bob", "Client_ID: 'me@x.org'", "login=ab", key(40, letters), key(60, letters), "https://a.example/x?y=1", "S3://bucket/k", "é\U0001f600", "\n\n", "text " * 60, "x" * 300]
    rows = [(i, " ".join(r.choices(parts, k=r.choice((1, 2, 4, 9, 30))))) for i in range(150)]
    rows += [(None, "token=abcdefgh"), (900, None), (901, ""), (902, "user=alice " * 3_000 + "token=abcdefgh"), (903, f"{key(40, letters)} " * 500 + "AKIA" + "B" * 16)]
    return rows + rows[:20]


def credentials_of(kind):
    return lambda s: s["kind"] == kind


def found(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in CLASHING})
    result = credentials.credentials(table)
    number = [F.size(F.filter("base", credentials_of(i))) for i in range(3)]
    return sorted((tuple(r) for r in result.select("doc_id", *number, F.sha2(credentials.listed(F.col("base")), 256), credentials.listed(F.col("found"))).collect()), key=str)


def test_odd_texts(spark, odd):
    assert found(spark, odd) == slow(odd)


def test_linking(spark):
    lone = "see https://a.example/x and login=alice"
    near = lone + " token=abcdefgh"
    far = lone + " " * 400 + "token=abcdefgh"
    spans = {i: s for i, *_, s in found(spark, [(1, lone), (2, near), (3, far)])}
    assert spans[1] == "" and spans[2] == line(sorted(search(near), key=lambda f: f[1])) and spans[3].startswith("assign:") and "," not in spans[3]


def test_empty_table(spark):
    assert found(spark, [(1, None)]) == slow([(1, None)])
    assert credentials.credentials(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python(spark, odd):
    plan = credentials.credentials(spark.createDataFrame(odd, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan
