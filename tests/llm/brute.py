"""Plain versions of the operators' contracts, over lists in memory."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, links):
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {i: root(i) for i in ids}


def embeddings(rows, least=0.93):
    """vec_id -> (n_links, component) of (id, vector, label)."""
    good = [(i, np.array(v, float), y) for i, v, y in rows if v is not None and y is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links, n = [], Counter()
    by = defaultdict(list)
    for i, v, y in good:
        by[y, len(v)].append((i, v / np.linalg.norm(v)))
    for group in by.values():
        x = np.array([v for _, v in group])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1))):
            links.append((group[a][0], group[b][0]))
            n.update(links[-1])
    part = components([r[0] for r in rows], links)
    return {r[0]: (n[r[0]], part[r[0]]) for r in rows}


def warc(rows):
    """page_id -> (bytes, digest, kind, refers_to) of (id, html)."""
    raw = {i: (h or "").encode() for i, h in rows}
    first = {}
    for i in sorted(raw):
        first.setdefault(raw[i], i)
    out = {}
    for i, p in raw.items():
        again = len(p) >= 100 and first[p] != i
        out[i] = (len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None)
    return out


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and _luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def pii(text):
    """(counts, spans) of the base kinds."""
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PII) for m in re.finditer(p, text or "") if ok(m[0])]
    spans = ",".join(f"{PII[k][0]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(f[1] == k for f in found) for k in range(4)], spans


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    twice = {w for w, c in Counter(windows).items() if c > 1}
    inside = {p for k, w in enumerate(windows) if w in twice for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def jaccard(rows, n, percent):
    """doc_id -> (set size, component) of (id, text)."""
    sets = {}
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    both = Counter((a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [(a, b) for (a, b), c in both.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    part = components(list(sets), links)
    return {i: (len(sets[i]), part[i]) for i in sets}


def repeats(rows, length=200):
    """doc_id -> (bytes, removed, spans, digest of the rest) of (id, text)."""
    raw = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(rest).hexdigest())
    return out


def crc(data):
    return zlib.crc32(data)
