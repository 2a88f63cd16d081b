"""Plain restatements of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def contamination(docs, items):
    """docs: (doc_id, text); items: (item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    sizes = sorted({len(k) for k in wins})
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in wins:
                    hit.update(range(p, p + n))
                    found |= {str(i) for i in wins[k] if i is not None}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def licenses(docs, base):
    out = []
    for d, t in docs:
        w, places = words(t), []
        for phrase, label, _ in base:
            p = phrase.split()
            places += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
        out.append((d, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x[1] for x in places}))))
    return out


def edits(phrase, text):
    """Least edits from one to the other that put no digit in."""
    row = list(range(len(phrase) + 1))
    for c in text:
        far = 99 if c.isdigit() else 0
        new = [row[0] + 1 + far]
        for j, p in enumerate(phrase):
            new.append(min(row[j] + (0 if p == c else 1 + far), row[j + 1] + 1 + far, new[j] + 1))
        row = new
    return row[-1]


def notice_edits(phrase, naming, stretch):
    """Edits that make the words of the stretch from the phrase's, its naming words unchanged; 99 and more: none do."""
    named = [i for i, w in enumerate(phrase) if w in naming]

    def gap(ws, left, right):
        return (" " if left else "") + "".join(w + " " for w in ws) if right else (" " if left and ws else "") + " ".join(ws)

    def rest(k, i, at):  # named words before k are placed; phrase from i, stretch from at are left
        if k == len(named):
            return edits(gap(phrase[i:], k, False), gap(stretch[at:], k, False))
        best = 99
        for b in range(at, len(stretch)):
            if stretch[b] == phrase[named[k]]:
                if named[k] == i and k:  # two naming words in a row
                    cost = 0 if b == at else 99
                elif named[k] == i:
                    cost = 0 if b == at else 99
                else:
                    cost = edits(gap(phrase[i : named[k]], k, True), gap(stretch[at:b], k, True))
                if cost < best:
                    best = min(best, cost + rest(k + 1, named[k] + 1, b + 1))
        return best

    return rest(0, 0, 0)


def notices(text, known, allowed):
    """label -> {(first word, last word + 1): edits} of every stretch of words that is a notice."""
    w, out = words(text), {}
    for phrase, label, naming in known:
        p, names = phrase.split(), set(naming.split())
        for a in range(len(w)):
            for b in range(a + 1, min(len(w), a + len(p) + 4) + 1):
                if abs(len(" ".join(w[a:b])) - len(phrase)) <= allowed(phrase):
                    k = notice_edits(p, names, w[a:b])
                    if k <= (allowed(phrase) if names != set(p) else 0):
                        out.setdefault((phrase, label), {})[a, b] = k
    return out


def simhash(docs):
    """docs: (doc_id, text) -> doc_id, fingerprint, component_id."""
    import xxhash

    prints = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, f"{prints[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(docs)]


def repeats(docs, width=200):
    """docs: (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    bodies, seen = [(t or "").encode() for _, t in docs], {}
    for b in bodies:
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] = seen.get(b[i : i + width], 0) + 1
    out = []
    for (d, _), b in zip(docs, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(rb"\x01+", gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out
