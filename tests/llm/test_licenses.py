import random
import re

from blotter.llm import licenses

SCHEMA = "doc_id long, text string, m int, top string"


def plain(text):
    text = text or ""
    units = text.split("\n") + ([text] if "\n" in text else [])
    hits = []
    for u in units:
        ws = re.findall("[a-z0-9]+", u.translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
        g = set(zip(ws, ws[1:]))
        for name, body in licenses.TEMPLATES:
            t = {tuple(x.split()) for x in licenses.bigrams(body)}
            dice = 2.0 * len(g & t) / (len(g) + len(t))
            if g and dice >= licenses.THRESHOLD:
                hits.append((dice, name))
    top = max(hits, default=(0.0, None))[0]
    return len(hits), ",".join(sorted({n for _, n in hits})), min([n for d, n in hits if d == top], default=None), top


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(150):
        name, body = rnd.choice(licenses.TEMPLATES)
        ws = body.split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            ws[rnd.randrange(len(ws))] = rnd.choice(["x", "license", "the", ""])
        lines = [" ".join(rnd.choice("lorem ipsum the license of it".split()) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 4))]
        lines.insert(rnd.randint(0, len(lines)), rnd.choice([" ".join(ws), "  ".join(ws).upper(), "* " + " ".join(ws) + " *"]))
        rows.append((i, "\n".join(lines)))
    rows += [(None, None), (None, ""), (3, rows[3][1]), (500, "\n\n"), (501, "MIT"), (502, "word " * 50000 + "\n" + licenses.TEMPLATES[0][1]),
             (503, licenses.TEMPLATES[0][1].replace(" ", "\n")), (504, "é".join(licenses.TEMPLATES[11][1].split(" ")))]
    got = licenses.license_scan(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, *plain(t)) for i, t in rows], key=repr)
    assert sum(r.n_matches > 0 for r in got) > 50


def test_bounds_are_tight():
    for t in range(1, 60):
        low, high = licenses.bounds(t, 0.8)
        ok = [n for n in range(1, 200) if 2 * min(n, t) / (n + t) >= 0.8 - 1e-12]
        assert (low, high) == (min(ok), max(ok))


def test_edges(spark):
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "MIT License", 1, "x")], SCHEMA)
    assert licenses.license_scan(one, templates=[("X", "one")]).first().n_matches == 0
