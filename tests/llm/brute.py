"""Plain single-process versions of the operators' contracts, for tests."""

import hashlib
import re

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words5(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(text, items, window=10):
    """(n_words, n_hit, n_items, items_sha256) of a text against (id, text) items."""
    ws = words5(text)
    hit, found = set(), set()
    for item, body in items:
        iw = words5(body)
        if not iw:
            continue
        n = min(window, len(iw))
        grams = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i:i + n]) in grams:
                hit.update(range(i, i + n))
                found.add("null" if item is None else str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def simhash(text, shingle=3):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + shingle]) for i in range(max(1, len(ws) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash_components(rows, max_bits=2):
    """(fingerprints, smallest id reachable, group) of each of the (id, text) rows."""
    fps = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min([x for x in (low.get(r), d) if x is not None], default=None)
    return fps, [low[find(i)] for i in range(len(rows))], [find(i) for i in range(len(rows))]


ASSIGN = re.compile("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(text):
    """Base spans (start, kind, end) in order."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)
