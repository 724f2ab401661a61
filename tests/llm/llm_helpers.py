"""Brute-force versions of the numbered operators, on plain Python values."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, sources=None):
    """A documents frame; None stays null."""
    ids = range(len(texts)) if ids is None else ids
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS)


def stored(df, tmp_path, name="documents"):
    path = str(tmp_path / f"{name}.parquet")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# -- secrets -------------------------------------------------------------------------------------------------

ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
KINDS = ["assign", "access", "hex", "entropy"]


def base_spans(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return out


def entropy_spans(text, allowed, window=24):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{24,}", text or ""):
        value = m[0]
        if any(re.search(a, value) for a in allowed):
            continue
        least = 3.0 if re.fullmatch("[0-9a-fA-F]+", value) else 4.0
        runs = []
        for i in range(len(value) - window + 1):
            counts = collections.Counter(value[i : i + window]).values()
            if math.log2(window) - sum(c * math.log2(c) for c in counts) / window >= least - 1e-6:
                if runs and runs[-1][1] >= i:
                    runs[-1][1] = i + window
                else:
                    runs.append([i, i + window])
        out += [("entropy", m.start() + a, m.start() + b) for a, b in runs]
    return out


def secret_row(text, allowed):
    def joined(spans):
        return ",".join("%s:%d:%d" % s for s in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))

    base = base_spans(text)
    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + entropy_spans(text, allowed)))


# -- decontamination -----------------------------------------------------------------------------------------


def alnum_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def contamination(texts, items, window=13):
    """(n_words, hit words, item ids) of each text."""
    windows = []
    for name, content in items:
        words = alnum_words(content)
        n = min(window, len(words))
        windows += [(name, words[i : i + n]) for i in range(len(words) - n + 1) if n]
    out = []
    for text in texts:
        words, hit, found = alnum_words(text), set(), set()
        for name, w in windows:
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(name)
        out.append((len(words), len(hit), sorted(found)))
    return out


# -- near duplicates -----------------------------------------------------------------------------------------


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def space_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower)


def shingles(text, size):
    words = space_words(text)
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def near_duplicates(texts, size, similarity=80):
    """texts: id -> text; gives id -> (set size, component)."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    ]
    found = components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


# -- repeats -------------------------------------------------------------------------------------------------


def without_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        runs = len(re.findall(b"\1+", bytes(covered)))
        out.append((len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


# -- language model ------------------------------------------------------------------------------------------


def language_model(texts, prior, order=2):
    """texts: id -> text; gives id -> (held out, tokens, known, N, base score, score) of the interpolated model."""
    tokens = {i: [*space_words(t), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter()
    for i, words in tokens.items():
        if not held[i]:
            led = ["^", *words]
            for k in range(1, order + 1):
                counts.update(tuple(led[j - k + 1 : j + 1]) for j in range(max(1, k - 1), len(led)))
    counts["^",] = counts[None,]  # a text starts as often as one ends
    single = {w: n for w, n in counts.items() if len(w) == 1 and w != ("^",)}
    total, types = sum(single.values()), sum(n > 0 for n in single.values())
    out = {}
    for i, words in tokens.items():
        base = score = 0.0
        led = ["^", *words]
        for j in range(1, len(led)):
            p = (counts[led[j],] + 1) / (total + types + 1)
            base += math.log10(p)
            for k in range(2, min(order, j + 1) + 1):
                context = tuple(led[j - k + 1 : j])
                p = (counts[*context, led[j]] + prior * p) / (counts[context] + prior)
            score += math.log10(p)
        out[i] = held[i], len(words), sum(counts[w,] > 0 for w in words), total, base, score
    return out
