"""Plain versions of the operators, and the awkward rows that every one of them is given."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


LONG = " ".join(f"w{i * i % 997}" for i in range(20_000))


def awkward(spark, rows=(), text="text", key="doc_id"):
    """A table with nulls, empty, blank and very long texts, repeated rows, and extra columns of inner names."""
    given = [(900_001, None), (900_002, ""), (900_003, " \n\t "), (None, "a text without an id, twice over"), (900_004, LONG),
             (900_005, "one"), (900_006, "éè 日本 \x0b x\x00y ,,, ..  end "), (900_006, "éè 日本 \x0b x\x00y ,,, ..  end "), *rows]
    return spark.createDataFrame([(k, t, 7, "k", [1], "clash") for k, t in given],
                                 f"{key} long, {text} string, key long, row string, n array<int>, doc string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def copies(seed=5, n=200, vocabulary=40, most=80):
    """Texts that copy parts of earlier ones."""
    rng = random.Random(seed)
    names = [f"v{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        w = [rng.choice(names) for _ in range(rng.randint(0, most))]
        if rows and rng.random() < 0.7:
            old = rng.choice(rows)[1].split()
            a = rng.randint(0, len(old))
            w[len(w) // 2:len(w) // 2] = old[a:a + rng.randint(5, 60)]
        rows.append((i, " ".join(w)))
    return rows


def repeats_removed(rows, window=20):
    """{id: (words, removed, digest of the kept words)}; rows without an id take no part."""
    seen, out = {}, {}
    for i, text in sorted(set((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            g = tuple(w[p:p + window])
            if g in seen:
                gone[p:p + window] = [True] * window
            seen[g] = 1
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, r in zip(w, gone) if not r)))
    return out


def ctw(rows, held, depth):
    """{id: (n_tokens, n_known, train_tokens, base, score)} by an explicit context tree."""
    node = collections.defaultdict(lambda: [0, 0])
    kids = collections.defaultdict(set)

    def coded(t):
        return b"\xff" * depth + lower(t).encode() + b"\xff"

    def bits(x, j):
        return [((1 << s) | (x[j] >> (8 - s)), x[j] >> (7 - s) & 1) for s in range(8)]

    counts = collections.Counter()
    for i, t in rows:
        if held[i]:
            continue
        counts.update(words(lower(t)) + ["\0"])
        x = coded(t)
        for j in range(depth, len(x)):
            for pre, b in bits(x, j):
                for d in range(depth + 1):
                    node[pre, x[j - d:j]][b] += 1
                    if d:
                        kids[pre, x[j - d + 1:j]].add((pre, x[j - d:j]))
    kt = {k: math.lgamma(a + .5) + math.lgamma(b + .5) - 2 * math.lgamma(.5) - math.lgamma(a + b + 1) for k, (a, b) in node.items()}
    weighted = {}
    for k in sorted(node, key=lambda k: -len(k[1])):
        if len(k[1]) == depth:
            weighted[k] = kt[k]
        else:
            s = sum(weighted[c] for c in kids[k])
            m = max(kt[k], s)
            weighted[k] = math.log(.5) + m + math.log(math.exp(kt[k] - m) + math.exp(s - m))

    def one(pre, context):
        p = None
        for d in range(depth, -1, -1):
            k = pre, context[len(context) - d:] if d else b""
            if k in node:
                a, b = node[k]
                own = (b + .5) / (a + b + 1)
                share = math.exp(math.log(.5) + kt[k] - weighted[k])
                p = own if p is None else share * own + (1 - share) * p
        return .5 if p is None else p

    n, v, out = sum(counts.values()), len(counts), {}
    for i, t in rows:
        x, score = coded(t), 0.0
        for j in range(depth, len(x)):
            for pre, b in bits(x, j):
                p = one(pre, x[j - depth:j])
                score += math.log10(p if b else 1 - p)
        tokens = words(lower(t)) + ["\0"]
        out[i] = (len(tokens), sum(counts[w] > 0 for w in tokens), n,
                  sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in tokens), score)
    return out


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def jaccard_links(rows, size=4, percent=85):
    """For each row the number of other rows that it links with, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    out = [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                out[i] += 1
                out[j] += 1
    return out


def jaccard_components(rows, size=4, percent=85):
    """{id: (set size, component)} by comparing every pair that shares a shingle."""
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = frozenset(tuple(w[j:j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    met = collections.defaultdict(list)
    for i in sorted(sets):
        count = collections.Counter()
        for s in sets[i]:
            count.update(met[s])
            met[s].append(i)
        for j, o in count.items():
            if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def quality_measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    found = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if found[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    """(start, kind, end) by the rules as they are written."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def entropy_secrets(text, base, rules):
    """Every window's entropy, computed anew."""
    out = []
    for m in re.finditer(rules.CANDIDATE, text):
        s, w = m[0], rules.WINDOW
        if any(re.search(p, s) for p in rules.ALLOWED):
            continue
        bits = rules.HEX_BITS if re.search(rules.HEX_CLASS, s) else rules.KEY_BITS
        hit = [i for i in range(len(s) - w + 1)
               if -sum(c / w * math.log2(c / w) for c in collections.Counter(s[i:i + w]).values()) >= bits - 1e-9]
        if hit and not any(a < m.start() + hit[-1] + w and m.start() + hit[0] < b for a, _, b in base):
            out.append((m.start() + hit[0], 3, m.start() + hit[-1] + w))
    return out


def local_alignment(x, y, match=2, mismatch=-1, gap=-1):
    """Smith-Waterman score by the textbook recurrence."""
    h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a == b else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
    return max(map(max, h))
