"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def repeated_words(rows, width=50):
    first = {}
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < i:
                gone[s : s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_bytes(rows, length=200):
    count = Counter()
    for _, text in rows:
        b = (text or "").encode()
        count.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b) + 1)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, shingle=3):
    import xxhash

    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_components(rows, bits=3):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))]


KINDS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [s for _, _, s in sorted(out)]


def secrets(rows):
    out = []
    for d, t in rows:
        s = base_spans(t)
        out.append((d, *(sum(x.startswith(k[0] + ":") for x in s) for k in KINDS), hashlib.sha256(",".join(s).encode()).hexdigest()))
    return out


def quality(rows):
    out = []
    for d, t in rows:
        t, w = t or "", words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count, hit = Counter(grams), [False] * len(w)
        for i, g in enumerate(grams):
            if count[g] > 1:
                hit[i : i + 5] = [True] * 5
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * sum(hit) > 20 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(hit), failed))
    return out


def edited(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        m = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[: len(t) - m] + u[:m]).encode()).hexdigest(), shingles(t), shingles(t[: len(t) - m] + u[:m]), shingles(u)))
    return out


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def similar_groups(rows, least=0.8):
    """Of each row the first row, by (id, place), of its group: texts linked by Jaccard similarity of 5-word shingles. A missing id is the largest."""
    sets = [shingles("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or jaccard(sets[i], sets[j]) >= least:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _id long, h long, spans string, key string, n int"


def table(spark, rows):
    """rows: (doc_id, text); further columns clash with names the operators use themselves."""
    full = [(i, t, "en", "s", len(t or ""), "r", 7, 8, "x", "k", 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
