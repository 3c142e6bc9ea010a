"""Plain versions of the operators' definitions, on lists of texts."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser
from itertools import combinations

import numpy as np

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text, size):
    words = SPACE.findall((text or "").encode().translate(UPPER))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def jaccard_components(rows, size, percent):
    """rows: (id, text), ids distinct -> {id: (n_shingles, component)}"""
    sets = {i: shingles(t, size) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations([i for i in sets if sets[i]], 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def contained(rows, items, size=5, percent=80):
    wanted = {j: shingles(t, size) for j, t in items}
    out = set()
    for i, t in rows:
        own = shingles(t, size)
        out |= {(i, j) for j, s in wanted.items() if s and 100 * len(s & own) >= percent * len(s)}
    return out


def without_repeats(texts, length=200):
    """For each text its bytes, removed bytes, removed runs and the hash of what is left."""
    data = [(t or "").encode() for t in texts]
    times = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if times[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


FORMS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def _passes(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        twice = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def personal_data(text):
    """Counts by kind and the spans as a string."""
    spans = [(m.start(), k, m.end(), kind) for k, (kind, rx) in enumerate(FORMS) for m in rx.finditer(text or "") if _passes(kind, m[0])]
    counts = [sum(s[3] == kind for s in spans) for kind, _ in FORMS]
    return counts, ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def url_verdict(url, rules, default="allow"):
    """host, path, rule and verdict."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, default)))


def picture_feature(samples):
    """Mean, deviation and entropy of the samples, and the bits of rising neighbours among 8 x 9 means."""
    n = len(samples)
    mean = sum(samples) / n
    dev = math.sqrt(sum((x - mean) ** 2 for x in samples) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(samples).values())
    edges = [k * n // 72 for k in range(73)]
    cells = [sum(samples[a:b]) / (b - a) for a, b in zip(edges, edges[1:])]
    bits = "".join("1" if cells[9 * r + c + 1] > cells[9 * r + c] else "0" for r in range(8) for c in range(8))
    return f"{mean:.4f},{dev:.4f},{abs(entropy):.4f},{int(bits, 2):016x}"


class _Tree(HTMLParser):
    """Texts and children by path, of pages that close every element and have text in their innermost ones only."""

    def __init__(self):
        super().__init__()
        self.path, self.texts, self.children = [], defaultdict(list), defaultdict(list)

    def handle_starttag(self, tag, attrs):
        label = tag + "".join(f".{v}" for _, v in attrs)
        self.children[tuple(self.path)].append(label)
        self.path.append(label)

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        self.texts[tuple(self.path)].append(data)


def style_tree(rows, short):
    """rows: (host, html) -> {(host, hash of a node): (pages, importance of the branch)}; a site's equal pages are one."""
    out = {}
    for host in {h for h, _ in rows}:
        trees = []
        for page in sorted({p for h, p in rows if h == host}):
            t = _Tree()
            t.feed(page)
            trees.append(t)
        own, pages = {}, {}
        for path in {p for t in trees for p in [*t.texts, *t.children]}:
            m = pages[path] = sum(path in t.texts or path in t.children for t in trees)
            entropy = lambda counts: -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)
            said = {x for t in trees for x in t.texts.get(path, ())}
            shapes = Counter(" ".join(dict.fromkeys(t.children[path])) for t in trees if path in t.children)
            content = 1 - sum(entropy([c for t in trees if (c := t.texts.get(path, []).count(x))]) for x in said) / len(said) / math.log(m) if said and m > 1 else 0
            own[path] = max(content, entropy(list(shapes.values())) / math.log(m) if shapes and m > 1 else 0) if m > 1 else 1
        for path in own:
            if path:
                name = 0
                for label in path:
                    name = short(f"{name}/{label}")
                out[host, name] = (pages[path], round(max(v for p, v in own.items() if p[: len(path)] == path), 6))
    return out


_M = (1 << 64) - 1
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mixed(x):
    x ^= x >> 32
    x = x * _MIX & _M
    x ^= x >> 32
    x = x * _MIX & _M
    return x ^ x >> 32


def quality_features(text, bits):
    """Buckets of a text's words and of its runs of 3, 4 and 5 bytes, and the one of every text."""
    out = [0]
    plain = [(32 if c in b"\t\n\v\f\r" else c) + 1 for c in text]
    for n in (3, 4, 5):
        for k in range(len(plain) - n + 1):
            h = 0
            for c in plain[k : k + n]:
                h = (h * _BASE + c) & _M
            out.append((h + n - 1) * _MIX % (1 << 64) >> 64 - bits)
    for w in SPACE.findall(text):
        out.append(_mixed(_mixed(sum((c + 1) * pow(_BASE, k, 1 << 64) for k, c in enumerate(w)) & _M)) >> 64 - bits)
    return out


def fitted(texts, labels, q):
    """The folded table after training by the same steps, every gradient summed document by document."""
    rng = np.random.default_rng(7)
    vectors = (rng.random((1 << q.BITS, q.DIM)) - 0.5) / q.DIM
    weights, bias = np.zeros((2, q.DIM)), np.zeros(2)
    seen, seen_w, seen_b = defaultdict(lambda: 1e-6), np.full((2, q.DIM), 1e-6), np.full(2, 1e-6)
    rng = np.random.default_rng(7)
    docs = [Counter(quality_features(t, q.BITS)) for t in texts]
    for _ in range(q.EPOCHS):
        order = rng.permutation(len(docs))
        for first in range(0, len(docs), q.BATCH):
            part = order[first : first + q.BATCH]
            steps, gw, gb = defaultdict(lambda: np.zeros(q.DIM)), np.zeros((2, q.DIM)), np.zeros(2)
            for i in part:
                total = sum(docs[i].values())
                mean = sum(vectors[f] * (c / total) for f, c in docs[i].items())
                p = np.exp(weights @ mean + bias)
                wrong = (p / p.sum() - np.eye(2)[labels[i]]) / len(part)
                gw += np.outer(wrong, mean)
                gb += wrong
                for f, c in docs[i].items():
                    steps[f] += wrong @ weights * (c / total)
            for f, step in steps.items():
                seen[f] += (step**2).mean()
                vectors[f] -= q.RATE * step / math.sqrt(seen[f])
            seen_w += gw**2
            seen_b += gb**2
            weights -= q.RATE * gw / np.sqrt(seen_w)
            bias -= q.RATE * gb / np.sqrt(seen_b)
    return np.append(vectors @ (weights[1] - weights[0]), bias[1] - bias[0])
