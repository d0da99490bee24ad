"""Plain versions of the operators, and texts with awkward cases."""

from __future__ import annotations

import hashlib
import re
import zlib

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "Three more words here."), (7, "été über ñandú 東京 😀   x"),
    (8, "same text of more than five words stands here twice"), (9, "same text of more than five words stands here twice"), (9, "same text of more than five words stands here twice"),
    (10, "1234 5678 ---"), (11, "long " * 5000), (12, "don't we'll  I'M\r\n\r\n  end  "), (None, "null id here"), (13, "ab" * 300),
]


def rows(pairs):
    return [(i, t, "en" if t and "e" in t else None, "s", len(t or ""), "x") for i, t in pairs]


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def alnum_words(t):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t).encode())


def decontaminated(docs, bench):
    windows = {}
    for item, t in bench:
        w = alnum_words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, items = alnum_words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    items |= got
                    hit |= set(range(i, i + n))
        out.append((d, len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


BASE = [("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]


def base_spans(t):
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(BASE) for m in p.finditer(t or "") if ok(m)]
    return [(name, a, b) for a, _, b, name in sorted(found)]


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shingles(t, size=4):
    w = re.findall(rb"[^\x20\x09-\x0d]+", lower(t).encode())
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def jaccard_components(docs, size=4, share=85):
    sets = [(d, shingles(t, size)) for d, t in docs]
    by = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    links = set()
    for i, (d, s) in enumerate(sets):
        if d is None:
            continue
        count = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    count[j] = count.get(j, 0) + 1
        links |= {(d, sets[j][0]) for j, o in count.items() if sets[j][0] is not None and 100 * o >= share * (len(s) + len(sets[j][1]) - o)}
    comp = components({d for d, _ in docs}, links)
    return sorted(((d, len(s), comp[d]) for d, s in sets), key=str)


def repeated_lines(docs, min_words=1, share=80):
    """(doc, line number) of lines that match an earlier one."""
    lines = sorted({(d, i, frozenset(re.findall(rb"[^\x20\x09-\x0d]+", lower(x).encode()))) for d, t in docs if d is not None and t is not None for i, x in enumerate(t.split("\n"))}, key=lambda x: x[:2])
    by, out = {}, set()
    for k, (d, i, s) in enumerate(lines):
        if len(s) < min_words:
            continue
        count = {}
        for w in s:
            for j in by.get(w, ()):
                count[j] = count.get(j, 0) + 1
        if any((100 + share) * o >= share * (len(s) + len(lines[j][2])) and lines[j][:2] < (d, i) for j, o in count.items()):
            out.add((d, i))
        for w in s:
            by.setdefault(w, []).append(k)
    return out


WEAK = [("key_id", re.compile("(?<![A-Z0-9])AKIA[A-Z0-9]{8,13}(?![A-Z0-9])")), ("blob", re.compile("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")), ("endpoint", re.compile("https?://[A-Za-z0-9.-]+"))]


def secret_spans(t, scope=400):
    """Base spans and the weak ones that parts in reach complete, as (start, kind's place, end)."""
    kinds = ["assign", "access", "hex", "value", "key_id", "blob", "endpoint"]
    spans = [(name, a, b) for name, a, b in base_spans(t)]
    weak = [("value", m.start(), m.end()) for m in BASE[0][1].finditer(t) if 6 <= len(m[2]) < 12]
    for name, p in WEAK:
        weak += [(name, m.start(), m.end()) for m in p.finditer(t) if name != "blob" or all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    every, out = spans + weak, list(spans)
    for name, a, b in weak:
        near = {k for k, x, y in every if x < b + scope and y > a - scope}
        whole = (near & {"access", "key_id"} or name in ("access", "key_id")) and (near & {"assign", "hex", "value", "blob"} or name in ("value", "blob"))
        if whole and not any(x < b and y > a for _, x, y in spans):
            out.append((name, a, b))
    return sorted((a, kinds.index(k), b) for k, a, b in out)


def language_model(rows, sample, dims, epochs, alpha, beta, l1, l2, seed):
    """(languages, scores of a text): rows (text, lang) give document frequencies, the sample's rows the weights, in their order."""
    import math

    import numpy as np

    def mixed(x):
        m = (1 << 64) - 1
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    def features(t):
        m = (1 << 64) - 1
        c = [48 if x in range(48, 58) else x if x > 127 or chr(x).isalpha() else 32 for x in map(ord, t.lower())]
        count = {}
        for i, x in enumerate(c):
            keys = [mixed(x)]
            if i + 1 < len(c):
                two = (mixed(x) * 3 & m) ^ (mixed(c[i + 1]) * 0x9E3779B97F4A7C15 & m)
                keys.append(mixed(two))
                if i + 2 < len(c):
                    keys.append(mixed((two * 5 & m) ^ (mixed(c[i + 2]) * 0xC2B2AE3D27D4EB4F & m)))
            for k in keys:
                count[k % dims] = count.get(k % dims, 0) + 1
        return count

    every = [features(t) for t, _ in rows]
    seen = [0] * dims
    for f in every:
        for k in f:
            seen[k] += 1
    idf = [math.log((1 + len(rows)) / (1 + s)) + 1 for s in seen]

    def vector(t):
        x = {k: (1 + math.log(n)) * idf[k] for k, n in features(t).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {k: v / size for k, v in x.items()}

    langs = sorted({lang for _, lang in sample})
    z, n = ([{} for _ in langs] for _ in range(2))
    bias = dims

    def weight(c, k):
        a = z[c].get(k, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(n[c].get(k, 0.0))) / alpha + l2)

    data = [({**vector(t), bias: 0.1}, langs.index(lang)) for t, lang in sample]
    fit = [d for i, d in enumerate(data) if i % 5 or len(data) < 20]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(fit)):
            x, label = fit[i]
            w = [{k: weight(c, k) for k in x} for c in range(len(langs))]
            s = [sum(w[c][k] * v for k, v in x.items()) for c in range(len(langs))]
            e = [math.exp(v - max(s)) for v in s]
            for c in range(len(langs)):
                g0 = e[c] / sum(e) - (c == label)
                for k, v in x.items():
                    g = g0 * v
                    had = n[c].get(k, 0.0)
                    z[c][k] = z[c].get(k, 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / alpha * w[c][k]
                    n[c][k] = had + g * g
    return langs, lambda t: [sum(weight(c, k) * v for k, v in {**vector(t), bias: 0.1}.items()) for c in range(len(langs))]
