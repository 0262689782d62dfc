"""Plain, slow versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def split(text):
    return WORD.findall(text or "")


def first_words(text, n):
    """The text up to the end of its n-th word."""
    return text[: [m.end() for m in WORD.finditer(text)][n - 1]]


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = split(low)
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, most=4):
    """The least index reachable from each index."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def base_counts(text):
    w = split(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, dup, len(covered)


def buckets(text, n=1 << 16):
    mask = (1 << 64) - 1
    h = [xxhash.xxh3_64_intdigest(x.encode()) for x in split(text)]
    one = [(x * 0xBF58476D1CE4E5B9 & mask) >> 48 for x in h]
    two = [(((a * 0x9E3779B97F4A7C15 + b) & mask) * 0xD6E8FEB86659FD93 & mask) >> 48 for a, b in zip(h, h[1:])]
    return [x % n for x in one + two]


def quality(texts, trusted, lost=0.005, prior=0.1, n=1 << 16):
    """(kept, score) of each text."""
    raw, good = Counter(), Counter()
    for t, ok in zip(texts, trusted):
        raw.update(buckets(t))
        if ok:
            good.update(buckets(t))
    total = sum(raw.values())

    def score(f, target, size):
        def ratio(b):
            share = (raw[b] + 1) / (total + n)
            return math.log((target[b] / size + prior * share) / (1 + prior)) - math.log(share)

        return sum(map(ratio, f)) / max(1, len(f)) if size else 0.0

    def passes(t):
        w, _, _, _, again = base_counts(t)
        return not (w < 20 or 100 * again > 30 * w)

    alone, size = [], sum(good.values())
    for t, ok in zip(texts, trusted):
        f = buckets(t)
        if ok and passes(t) and len(f) < size:
            alone.append(score(f, good - Counter(f), size - len(f)))
    threshold = -math.inf if size else 0.0
    if alone:
        threshold = math.floor(sorted(alone)[int(lost * len(alone))] * 1000) / 1000
    scores = [score(buckets(t), good, size) for t in texts]
    return [(passes(t) and x >= threshold, x) for t, x in zip(texts, scores)]


def sentences(text):
    """(words, start) of each sentence."""
    found = list(WORD.finditer(text or ""))
    out, words, start = [], [], None
    for i, m in enumerate(found):
        start = m.start() if start is None else start
        words.append(m[0])
        gap = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
        if m[0][-1] in ".!?" or "\n" in gap:
            out.append((words, start))
            words, start = [], None
    return out


def runs(text, sentence_count=3, least=24, long=24):
    """(first, end, words) of each run, first and end numbers of words."""
    s = sentences(text)
    words = [w for x in s for w in x[0]]
    begin, at = [], 0
    for x in s:
        begin.append(at)
        at += len(x[0])
    ends = [b + len(x[0]) for b, x in zip(begin, s)]
    for i in range(len(s)):
        for j in range(i + sentence_count - 1, len(s)):
            if ends[j] - begin[i] >= least:
                yield begin[i], ends[j], tuple(words[begin[i] : ends[j]])
                break
    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
    for i in range(len(words) - long + 1):
        if i in begin or 1 < i < len(words) - 2 and h[i] < min(h[i - 2 : i] + h[i + 1 : i + 3]):
            whole = sum(i <= a and b <= i + long for a, b in zip(begin, ends))
            if whole < sentence_count:
                yield i, i + long, tuple(words[i : i + long])


def substrings(rows):
    """[(id, text)] -> [(text left, sentences, sentences that lost words)] in the rows' order; a null id comes first, then equal ids by the texts' hashes."""
    owner, keys = {}, [(-(1 << 63) if k is None else k, text_hash(text)) for k, text in rows]
    for k, (_, text) in zip(keys, rows):
        for *_, words in runs(text):
            owner[words] = min(owner.get(words, k), k)
    out = []
    for k, (_, text) in zip(keys, rows):
        text, seen, gone = text or "", set(), set()
        for i, j, words in sorted(runs(text)):
            if owner[words] < k or words in seen:
                gone.update(range(i, j))
            seen.add(words)
        found = list(WORD.finditer(text))
        ends = [m.start() for m in found[1:]] + [len(text)]
        left = text[: found[0].start()] if found else text
        left += "".join(text[m.start() : e] for i, (m, e) in enumerate(zip(found, ends)) if i not in gone)
        s, at, cut = sentences(text), 0, 0
        for x in s:
            cut += any(i in gone for i in range(at, at + len(x[0])))
            at += len(x[0])
        out.append((left, len(s), cut))
    return out


def text_hash(text):
    """XXH64 with seed 42 as a signed number without its lowest bit."""
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) & ~1


def targets(sizes, weights=(5, 2, 1)):
    """Targets of sources (None last) from {source: size}, by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        ahead = sum(w[s] for s in order if s not in full)
        t = {s: 3 * sizes[s] if s in full else rest * w[s] / ahead for s in order}
        over = {s for s in order if t[s] > 3 * sizes[s] and s not in full}
        if not over:
            return t
        full |= over


def mix(rows):
    """[(id, source, size)] -> taken of each row; ids are distinct."""
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    out, goal = {}, targets(sizes)
    for source in sizes:
        left = math.floor(goal[source] + 0.5)
        own = sorted((hashlib.md5(("" if k is None else str(k)).encode()).hexdigest(), k, size) for k, s, size in rows if s == source)
        full, rest = divmod(left, sizes[source]) if sizes[source] else (0, 0)
        for _, k, size in own:
            part = max(0, min(size, rest))
            out[k] = full * size + part
            rest -= part
    return out


def greedy(word, vocabulary):
    """The number of greedy pieces, 0 if there are none."""
    at, n = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (not at, word[at:end]) in vocabulary:
                break
        else:
            return 0
        at, n = end, n + 1
    return n


def classifier(x, y, fold, every):
    """Scores of the statistics `every`, from rows x with labels y: Fourier features, ridge, calibration by pooled bins of held-out scores."""
    rng = np.random.default_rng(9)
    directions, shift = rng.normal(size=(x.shape[1], 256)) / math.sqrt(x.shape[1]), rng.uniform(0, 2 * math.pi, 256)
    centre, scale = x.mean(0), x.std(0)
    scale[scale <= 1e-9] = 1

    def features(v):
        inside = np.minimum(8, np.maximum(-8, (v - centre) / scale))
        return np.hstack([np.ones((len(v), 1)), np.cos(inside @ directions + shift) * math.sqrt(2 / 256)])

    def ridge(z, t):
        return np.linalg.solve(z.T @ z + 1e-3 * len(z) / 256 * np.eye(257), z.T @ t)

    z = features(x)
    bins = defaultdict(list)
    for f in set(fold):
        raw = z[fold == f] @ ridge(z[fold != f], y[fold != f])
        for r, t in zip(raw, y[fold == f]):
            bins[min(1999, max(0, int((r + 0.5) * 1000)))].append(t)
    pools = []
    for b in sorted(bins):
        pools.append((bins[b], [(b + 0.5) / 1000 - 0.5] * len(bins[b])))
        while len(pools) > 1 and np.mean(pools[-2][0]) >= np.mean(pools[-1][0]):
            last = pools.pop()
            pools[-1] = (pools[-1][0] + last[0], pools[-1][1] + last[1])
    return np.interp(features(every) @ ridge(z, y), [np.mean(p[1]) for p in pools], [np.mean(p[0]) for p in pools])


TABLE = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32).tolist()


def piecewise(data, block):
    """The signature at a block size, byte by byte: pieces end where the hash of the last seven bytes has the low bits set; a letter a piece, no letter more than three times in a row."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    mask, out, start = (1 << 64) - 1, [], 0

    def rotated(v, by):
        return (v << by | v >> (32 - by)) & 0xFFFFFFFF if by else v

    for i in range(len(data)):
        h = 0
        for back in range(min(7, i + 1)):
            h ^= rotated(TABLE[data[i - back]], 4 * back)
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 15
        if h % block == block - 1 or i == len(data) - 1:
            p = sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(data[start : i + 1])) & mask
            p ^= p >> 32
            out.append(letters[(p * 0x9E3779B97F4A7C15 & mask) >> 58])
            start = i + 1
    return "".join(c for i, c in enumerate(out) if i < 3 or not c == out[i - 1] == out[i - 2] == out[i - 3])


def fingerprint(text):
    data, block = text.encode(), 2
    while block * 64 < len(data) or len(piecewise(data, block)) > 256 and block < len(data):
        block *= 2
    return ":".join([str(block), *(piecewise(data, block * k) if data else "" for k in (1, 2, 4))])


def likeness(x, y):
    """1 less the part of insertions and deletions between two fingerprints' signatures at their finest common block size."""
    if x == y:
        return 1.0
    (a, *s), (b, *t) = x.split(":"), y.split(":")
    s, t = ({int(n) * 2**i: v for i, v in enumerate(p)} for n, p in ((a, s), (b, t)))
    common = sorted(set(s) & set(t))
    if not common:
        return 0.0
    s, t = s[common[0]], t[common[0]]
    if not s or not t:
        return float(s == t)
    need = max(1, min(4, len(s) // 3, len(t) // 3))
    if not any(s[i : i + need] in t for i in range(len(s) - need + 1)):
        return 0.0
    d = [list(range(len(t) + 1))]
    for i in range(1, len(s) + 1):
        d.append([i])
        for j in range(1, len(t) + 1):
            d[i].append(d[i - 1][j - 1] if s[i - 1] == t[j - 1] else 1 + min(d[i - 1][j], d[i][j - 1]))
    return 1 - d[-1][-1] / (len(s) + len(t))
