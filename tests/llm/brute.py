"""Plain versions of the corpus operators, straight from their definitions."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def base_spans(text):
    text = text or ""
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def spans_sha(text):
    return hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()


def window_entropy(run, width=20):
    import math

    best = 0.0
    for i in range(len(run) - width + 1):
        counts = Counter(run[i:i + width])
        best = max(best, -sum(c / width * math.log2(c / width) for c in counts.values()))
    return best


def fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=4):
    """``rows``: (doc_id, fingerprint); the smallest id reachable of each row."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    best = {}
    for d, f in rows:
        if d is not None:
            best[find(f)] = min(best.get(find(f), d), d)
    return [(d, f, best.get(find(f))) for d, f in rows]


def plain_words(text):
    clean = "".join(c if c.isalnum() else " " for c in (text or "").lower())
    return clean.split()


def shingles(text, width=5):
    words = plain_words(text)
    return {" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def contained(docs, items, threshold=0.8):
    out = set()
    widths = {len(plain_words(item)) for _, item in items} & {1, 2, 3, 4}
    for item_id, item in items:
        own = shingles(item)
        for doc_id, text in docs:
            words = plain_words(text)
            found = shingles(text) | {" ".join(words[i:i + k]) for k in widths for i in range(len(words) - k + 1)}
            if own and len(own & found) >= threshold * len(own) - 1e-9:
                out.add((item_id, doc_id))
    return out
