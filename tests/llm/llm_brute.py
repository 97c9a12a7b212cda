"""Plain Python versions of the operators, and awkward rows to hold them against."""

import hashlib
import math
import re
import zlib
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Columns of documents, then ones whose names the operators use themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, target double, n long, row long, text_hash string, shard int,"
    " kept boolean, block string, key string, hash long, u long, g long, at int, listed string, level double, root long, _row_id long"
)
EXTRA = (7, 0.5, 1, 2, "x", 3, True, "b", "k", 4, 5, 6, 7, "l", 0.1, 9, 8)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def sentence(seed, n):
    words, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        words.append("w%d" % (x >> 8 & 0x3FF))
    return " ".join(words)


def morse(n, a="a", b="b"):
    """A Thue-Morse word of n letters: it and its complement have equal polynomial hashes modulo 2**64."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def awkward_rows():
    base = sentence(1, 120)
    near = base.split()
    near[60] = "changed"
    shared = sentence(2, 80)
    rows = [
        (1, None, "en", "web"),
        (2, "", "en", "web"),
        (3, "word", "en", "web"),
        (4, "word", "de", "web"),
        (5, "  \t\n ", "en", None),
        (6, base, "en", "web"),
        (7, base, "en", "books"),
        (8, " ".join(near), "en", "books"),
        (8, " ".join(near), "en", "books"),
        (9, base.upper(), None, "books"),
        (10, sentence(3, 60) + "\n" + shared, "en", "news"),
        (11, sentence(4, 70) + "\n" + shared + "\n" + sentence(5, 9), "fr", "news"),
        (12, "one two three four", "en", "news"),
        (13, "One Two THREE four", "en", "news"),
        (14, "ab" * 400, "en", "web"),
        (15, sentence(6, 4000), "en", "web"),
        (16, "línea única ☃ 𝒳 " * 30, "es", ""),
        (17, "same line here now\n" * 8 + sentence(7, 40), "en", "web"),
        (18, "x # $ % | < > & *\n" * 3 + sentence(8, 55), "en", "web"),
        (None, sentence(9, 90), "en", "web"),
        (None, base, "en", None),
        (21, "<|endoftext|> it's  2024 don't <|endoftext|>", "en", "web"),
        (22, sentence(10, 52) + " " + sentence(11, 30), "en", "web"),
        (24, morse(1024) + " and " + morse(1024, "b", "a"), "en", "web"),
        (25, morse(1024, "b", "a") + " and " + morse(1024), "en", "web"),
        (26, morse(1024) + "\n" + morse(1024, "b", "a") + "\n" + morse(1024, "xy ", "yx "), "en", "web"),
        (27, morse(1024, "yx ", "xy ") + "\n" + morse(1024, "xy ", "yx "), "en", "web"),
        (23, sentence(12, 300) + " " + sentence(11, 30), "en", "web"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows]


BENCHMARK = [
    ("b1", sentence(11, 30)),
    ("b2", "Word"),
    ("b3", None),
    ("b4", ""),
    (None, sentence(2, 80)),
    ("b1", sentence(11, 30)),
    ("b6", "no where to be found at all in any of the documents here today ok"),
]


def shingles(text):
    words = SPACED.findall(lower(text))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


class Union:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a, b):
        self.parent[self.find(a)] = self.find(b)


def components(sets):
    """Places in a list of sets to their component, by comparing every two that share an element."""
    u, first, having = Union(len(sets)), {}, {}
    for i, s in enumerate(sets):
        if s:
            u.join(i, first.setdefault(s, i))
    for s, i in first.items():
        common = Counter(j for e in s for j in having.get(e, ()))
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                u.join(i, j)
        for e in s:
            having.setdefault(e, []).append(i)
    return [u.find(i) for i in range(len(sets))]


def jaccard_join(docs):
    """[(doc_id, text)] to [(doc_id, n_shingles, component_id)]"""
    sets = [shingles(t) for _, t in docs]
    roots = components(sets)
    least = {}
    for (i, _), s, r in zip(docs, sets, roots, strict=True):
        if s and i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, len(s), least.get(r) if s else i) for (i, _), s, r in zip(docs, sets, roots, strict=True)]


def repeats(docs, length=200):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def base_scores(docs):
    """[(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)]"""
    tokens = [[*SPACED.findall(lower(t)), None] for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in docs]
    count = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(count.values()), len(count)
    return [
        (i, h, len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        for (i, _), t, h in zip(docs, tokens, held, strict=True)
    ]


def contamination(docs, benchmark):
    items = {}
    for item, text in benchmark:
        words = ALNUM.findall(lower(text))
        n = min(13, len(words))
        for s in range(len(words) - n + 1) if n else ():
            items.setdefault(tuple(words[s : s + n]), set()).add(item or "")
    sizes = {len(w) for w in items}
    out = []
    for i, text in docs:
        words = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(words) - n + 1):
                if (w := tuple(words[s : s + n])) in items:
                    hit.update(range(s, s + n))
                    found |= items[w]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def quality_counts(docs):
    """[(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)]"""
    out = []
    for i, text in docs:
        text = text or ""
        words = SPACED.findall(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        again = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)))
    return out


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """{source: size} to {source: target}, by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, free = {}, set(sizes)
    left = share * sum(sizes.values())
    while free:
        level = (left - sum(capped.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: cap * sizes[s] for s in over}
        free -= over
    return capped


def vector_codes(rows, parts=8, entries=16, rounds=6):
    """[(vec_id, label, code, error)] and the codebooks' text, in Python's whole numbers."""
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    good = [(i, v, label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    good = [r for r in good if len(r[1]) == len(min(good, key=order)[1])]
    width = len(good[0][1]) // parts if good else 0
    cut = [[[math.floor(4096 * x) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in good]
    first = sorted(range(len(good)), key=lambda k: order(good[k]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]
    away = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (away(x, book[e]), e))
    for _ in range(rounds):
        codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for (i, _, label), c in zip(good, cut, strict=True):
        code = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for e in code), sum(away(c[p], books[p][code[p]]) for p in range(parts))))
    return out, ",".join(str(x) for book in books for e in book for x in e)


def resampled(docs, target, share=25, least=20, seed=7, buckets=10_000):
    """[(doc_id, n_features, weight, score, drawn)] with the ranks of the drawn, in order."""
    words = lambda t: ALNUM.findall(lower(t))
    features = lambda w: [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    given = [(i, words(t)) for i, t in docs]
    s = Counter(bucket(f) for _, w in given for f in features(w))
    t = Counter(bucket(f) for _, x in target for f in features(words(x)))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * float(s.total() + buckets) / ((s[b] + 1) * float(t.total() + buckets)))) for b in s}
    rows = []
    for i, w in given:
        f = features(w)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((k for k in range(len(rows)) if rows[k][4] >= least), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    rank = {k: n + 1 for n, k in enumerate(able[: share * len(able) // 100])}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(rows)]


def line_shingles(line, k=9):
    return frozenset(line[i : i + k] for i in range(max(1, len(line) - k + 1)))


def in_order(rows):
    return sorted(rows, key=repr)
