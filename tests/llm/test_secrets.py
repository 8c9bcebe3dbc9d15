import base64
import hashlib
import math
import random
import re

import brute
from blotter.llm import secrets
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, spans string, scan int, n_chars long"
KINDS = ["assign", "access", "hex"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def texts():
    rnd = random.Random(2)
    b64 = lambda n: base64.b64encode(rnd.randbytes(n)).decode()
    out = [None, "", "token=token = abcdefgh", "PassWord: 'hunter22' and passwd=short1", "api_key = \"Ab/+=_.-x\" APIKEY:123456", "tokEn=abc",
           "é😀 secret = 😀 secret=é secret: abcdef", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 20 + " AKIA123", "f" * 23 + " " + "f" * 24 + "g" + "0" * 30,
           "token = \"" + rnd.randbytes(20).hex() + "\" end", "ſecret=abcdefg toKen=abcdefg", "password=" * 5 + "abcdef",
           "secretsecret=abcdefsecret=abcdefg", "x " * 40000 + "token=abcdef123 " + "deadbeef" * 4]
    for _ in range(60):
        out.append(" ".join(rnd.choice(["lorem", "ipsum", b64(30), rnd.randbytes(16).hex(), "an-ordinary-hyphenated-word-2", "aaaaaaaaaaaaaaaaaaaaaaaa1"]) for _ in range(10)))
    return out


def test_base_spans_against_brute_force(spark):
    data = texts()
    for r in secrets.secret_scan(table(spark, data)).collect():
        want = brute.base_spans(data[r.doc_id])
        named = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3)), r
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == (named.split(",") if named else [])


def test_random_runs_are_added_and_structured_ones_not(spark):
    rnd = random.Random(4)
    keys = [base64.b64encode(rnd.randbytes(30)).decode() for _ in range(100)]
    dull = ["Aa1" * 14 for _ in range(100)]
    words = ["thisIsAVeryLongIdentifierName%d" % i for i in range(100)]
    rows = secrets.secret_scan(table(spark, keys + dull + words)).collect()
    hit = {r.doc_id for r in rows if "random" in r.spans}
    assert len(hit & set(range(100))) >= 90
    assert len(hit - set(range(100))) <= 10


def test_battery_p_values_are_even_on_random_strings(spark):
    rnd = random.Random(9)
    runs = [(base64.b64encode(rnd.randbytes(90)).decode(),) for _ in range(400)]
    p = [r[0] for r in spark.createDataFrame(runs, "s string").select(secrets.battery(F.col("s"))["p"]).collect()]
    assert 0 < sum(x < 0.1 for x in p) < 80 and sum(x > 0.5 for x in p) > 120


def test_keys_in_urls_and_paths_are_tested_apart(spark):
    rnd = random.Random(6)
    urlsafe = lambda: base64.urlsafe_b64encode(rnd.randbytes(20)).decode().rstrip("=") + "-" + base64.urlsafe_b64encode(rnd.randbytes(24)).decode()
    keys = [urlsafe() for _ in range(120)]
    heads = ["https://x.org/api/webhooks/123456/" if i % 2 else "see /my-app/" for i in range(120)]
    rows = secrets.secret_scan(table(spark, [h + k for h, k in zip(heads, keys)])).collect()
    right = [f"random:{len(heads[r.doc_id])}:{len(heads[r.doc_id]) + len(keys[r.doc_id])}" in r.spans.split(",") for r in rows]
    assert sum(right) >= 100
    for r in rows:
        spans = sorted(tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("random"))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_a_lone_key_of_a_small_stratum(spark):
    rnd = random.Random(7)
    keys = [base64.b64encode(rnd.randbytes(30)).decode() for _ in range(300)]
    long = [(base64.b64encode(rnd.randbytes(210)).decode().replace("+", "a").replace("/", "b"),) for _ in range(40)]
    p = [(r.p, r.s) for r in spark.createDataFrame(long, "s string").select("s", secrets.battery(F.col("s"))["p"].alias("p")).collect()]
    lone = next(s for x, s in sorted(p) if 0.2 <= x < 0.5)
    rows = secrets.secret_scan(table(spark, [*keys, lone])).collect()
    assert [r.spans for r in rows if r.doc_id == 300] == [f"random:0:{len(lone)}"]


def test_redact(spark):
    data = texts()
    d = table(spark, data)
    out = secrets.redact(d)
    assert out.columns == d.columns
    spans = {r.doc_id: r.spans for r in secrets.secret_scan(d).collect()}
    for r in out.collect():
        t, pieces, at = data[r.doc_id], [], 0
        if not spans[r.doc_id]:
            assert r.text == t
            continue
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[r.doc_id].split(",")):
            if a >= at:
                pieces += [t[at:a], "[secret]"]
            at = max(at, b)
        assert r.text == "".join(pieces) + t[at:] and r.n_chars == len(r.text)


def test_empty_table(spark):
    assert secrets.secret_scan(table(spark, [])).collect() == []
    assert secrets.redact(table(spark, [])).collect() == []


def plain_p(body, alphabet):
    """The battery's p of a run, by the standard library."""
    k, x = len(alphabet), [alphabet.index(c) for c in body]
    n = len(x)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum((x.count(v) - n / k) ** 2 for v in range(k)) / (n / k)
    third = 2 / (9 * (k - 1))
    p_chi = tail(((chi / (k - 1)) ** (1 / 3) - (1 - third)) / math.sqrt(third))
    high = [v >= k // 2 for v in x]
    n1 = sum(high)
    n0 = n - n1
    turns = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * n0 * n1 / n + 1
    var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    p_runs = 0.5 ** (n - 1) if not n0 or not n1 else 2 * tail(abs(turns - mean) / math.sqrt(var))
    lag = sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(x, x[1:]))
    p_lag = 2 * tail(abs(lag / ((k * k - 1) / 12) / math.sqrt(n - 1)))
    return min(1.0, 3 * min(p_chi, p_runs, p_lag))


def test_battery_equals_the_formulas(spark):
    rnd = random.Random(12)
    runs = []
    for i, (_, pattern, alphabet) in enumerate(secrets.ENCODINGS):
        for n in (20, 25, 40, 64, 200):
            for some in (alphabet, alphabet[:12] + alphabet[-2:], alphabet[:2] + "".join(c for c in alphabet if c.isdigit())[:1]):
                runs.append("".join(rnd.choice(some) for _ in range(n)))
    rows = spark.createDataFrame([(r,) for r in runs], "run string").select("run", secrets.battery(F.col("run")).alias("t")).collect()
    tested = 0
    for r in rows:
        fits = [i for i, (_, pattern, _) in enumerate(secrets.ENCODINGS) if re.search(pattern, r.run)]
        mixed = re.search("[0-9]", r.run) and re.search("[A-Za-z]", r.run) and len(r.run) >= 20
        if not fits or not mixed:
            assert r.t.encoding == -1
            continue
        assert r.t.encoding == fits[0] and r.t.n == len(r.run)
        assert abs(r.t.p - plain_p(r.run, secrets.ENCODINGS[fits[0]][2])) < 2e-6
        tested += 1
    assert tested > 20
