"""Small fixtures and brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, id long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def documents(spark, texts, langs=None, sources=None):
    """Rows with extra columns whose names operators use inside."""
    rows = [(k, t, (langs or ["en"])[k % len(langs or [1])], (sources or ["s0", "s1", None])[k % len(sources or [1, 2, 3])], len(t or ""), "clash", -k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus(n=60, seed=1, vocabulary=400):
    """Random texts with exact and near copies, shared passages, periodic, empty and null ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["an", "er", "to", "ß", "é", "mi", "Ka", "x."]) for _ in range(rng.randrange(1, 5))) for _ in range(vocabulary)]
    line = " ".join(rng.choice(vocab) for _ in range(50))
    out = [None, "", "  \n", "one", "two words", "one", "Und " * 120, "a b c d e f g " * 30]
    while len(out) < n:
        kind = rng.randrange(6)
        text = " ".join(rng.choice(vocab) for _ in range(rng.choice([4, 5, 40, 80, 150])))
        if kind == 0 and len(out) > 12:
            text = rng.choice(out[8:])
        elif kind == 1 and len(out) > 12:
            w = rng.choice(out[8:]).split(" ")
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
        elif kind == 2:
            text = text + "\t" + line + "\n" + text[:20]
        out.append(text)
    return out


def repeats(texts, length):
    counts = Counter(tuple(w[i : i + length]) for w in map(words, texts) for i in range(len(w) - length + 1))
    out = []
    for w in map(words, texts):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if counts[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(texts, percent=80):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(len(s), root(k)) for k, s in enumerate(sets)]


def base_scores(texts):
    tokens = [[*words(lower(t)), None] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(texts))]
    c = Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for t, h in zip(tokens, held)]
