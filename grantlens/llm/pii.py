"""Operator 13: personal data by patterns, and by a linear-chain conditional random field.

Four base patterns (email, ip, card, phone) give the spans that are always
reported.  A conditional random field adds what they miss: phone numbers
without a plus, addresses written with "(at)" or with spaces, cards and ips
with other separators.

Tokens are runs of letters, runs of digits and single marks.  A token has nine
features, each a small number: its shape and the gap before it, the shapes of
two tokens on either side, the nearest cue word before it, the digits and
digit groups of the stretch of digits and marks around it, and the state of
the blank-delimited word it stands in.  Labels are O and a begin and an inside
label per kind.  The weights are trained on a small labelled table by gradient
steps on the log likelihood (forward-backward in numpy); texts are decoded by
Viterbi, all sequences of a batch side by side.

A sequence ends at a line break, and at white space between two quiet words,
which have neither a digit nor one of ``@()[]+``; features look across these
ends.  A sequence without a loud word is not decoded, because ``plausible``
would drop all that could be found in it.  A decoded span is added if it beats
the same words labelled O by ``MARGIN``, is plausible for its kind (numbers of
digits, Luhn, ranges), is not glued to letters or digits, and touches no base
span.

On Spark: one pass over the texts, no shuffle; the weights are 20,736 numbers
and go out with the function.  ``fit`` collects at most ``LABELLED_ROWS``
labelled rows, the first by their number.

Defined cases: a null text counts as empty; a text without finds has counts of
0, empty spans and the digest of the empty string; repeated rows give repeated
results; an empty table gives an empty result; columns other than key and text
are not read.
"""

from __future__ import annotations

import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm.common import keyed_schema, map_arrow, table, text_chunks
from grantlens.llm.pii_examples import labelled_lines
from grantlens.session import ensure_parallelism

KINDS = ("email", "ip", "card", "phone")
LABELLED_ROWS = 5000
#: Rows and seed of the labelled table of the query; steps and size of the training.
ROWS, SEED = 2000, 13
STEPS, RATE, SHRINK = 60, 0.15, 1e-3
#: Natural log units by which a span has to beat the same words without it.
MARGIN = 3.0

# ---------------------------------------------------------------- base patterns
_EMAIL_END = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part) <= 255 if len(part) < 400 else not part.lstrip("0")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order.  Each pattern is matched in one pass that never looks at a character often."""
    out = []
    # A local part holds no @, so it is the run before an @, as far as the match before left it.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = _EMAIL_END.match(text, at + 1) if start < at else None
        if end:
            out.append((start, 0, end.end()))
        done = end.end() if end else at + 1
        at = text.find("@", done)
    if _DIGITS.search(text):
        for m in _NUMBERS.finditer(text):
            if m[0].count(".") > 2:
                parts, at = m[0].split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i:i + 4]
                    size = sum(map(len, four)) + 3
                    if all(map(_small, four)):
                        out.append((at, 1, at + size))
                    at += size + 1
        for m in _CARD.finditer(text):
            if len(m[0]) >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- tokens and features
SPACE, LETTER, DIGIT, MARK = range(4)
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = LETTER
_LOUD = np.zeros(256, np.int64)
_LOUD[48:58] = 1
_LOUD[[ord(c) for c in "@()[]+"]] = 1
_STRETCH = np.zeros(256, bool)
_STRETCH[[ord(c) for c in "+-().[]/"]] = True
#: Shapes: 8 of letters, 17 of digits, then marks, then no token.
_DIGIT_SHAPE = np.array([0, 8, 9, 10, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 20, 21, 22, 22, 22, 23], np.uint8)
_MARK_SHAPE = np.full(256, 58, np.uint8)
for _i, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _MARK_SHAPE[ord(_c)] = 25 + _i
NONE, SHAPES = 59, 60
#: Cue words of each kind, in small letters.
CUES = {
    "email": ("email", "mail", "e", "write", "reach"), "ip": ("ip", "host", "server", "login", "address"),
    "card": ("card", "visa", "karte", "tarjeta", "paid"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "telephone", "contact")}
_DIGIT_SUM = np.array([0, 1, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 10, 11, 12, 12, 12, 13], np.uint8)
FEATURES = 9
LABELS = 1 + 2 * len(KINDS)


def _packed(words) -> np.ndarray:
    return np.array([int.from_bytes(w.encode()[:8].ljust(8, b"\0"), "little") for w in words], np.uint64)


_CUE_WORDS = _packed([w for k in KINDS for w in CUES[k]])
_CUE_KIND = np.array([i + 1 for i, k in enumerate(KINDS) for _ in CUES[k]], np.int64)
_CUE_ORDER = np.argsort(_CUE_WORDS)
_CUE_WORDS, _CUE_KIND = _CUE_WORDS[_CUE_ORDER], _CUE_KIND[_CUE_ORDER]


class Tokens:
    """The tokens of some texts (bytes and offsets), their sequences, and the features of the loud ones."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        kind = _CLASS[data]
        begin = np.ones(len(data), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == MARK)
        begin[off[:-1][off[:-1] < len(data)]] = True
        cut = np.flatnonzero(begin)
        token = kind[cut] != SPACE
        self.start = cut[token]
        self.end = np.append(cut[1:], len(data))[token]
        n = len(self.start)
        self.text = np.searchsorted(off, self.start, side="right") - 1
        self.data = data
        # Gaps: 0 none, 1 one blank, 2 more, 3 a line break or another text.
        lines = np.append(0, np.cumsum(data == 10))
        self.gap = np.full(n, 3, np.uint8)
        width = self.start[1:] - self.end[:-1]
        broken = (lines[self.start[1:]] != lines[self.end[:-1]]) | (self.text[1:] != self.text[:-1])
        self.gap[1:] = np.where(broken, 3, np.minimum(width, 2))
        # Words between blanks, and sequences.
        word = np.flatnonzero(self.gap > 0)
        loud = np.append(0, np.cumsum(_LOUD[data]))
        self.word_of = np.cumsum(self.gap > 0) - 1
        self.loud_word = loud[self.end[np.append(word[1:], n) - 1]] > loud[self.start[word]] if n else np.zeros(0, bool)
        quiet = ~self.loud_word[self.word_of]
        ends = (self.gap == 3) | (self.gap > 0) & quiet & np.append(True, quiet[:-1])
        first = np.flatnonzero(ends)
        length = np.diff(np.append(first, n))
        has = np.add.reduceat(~quiet, first) > 0 if n else np.zeros(0, bool)
        self.first, self.length = first[has], length[has]
        self.kind = kind

    def features(self) -> np.ndarray:
        """(FEATURES, tokens of the decoded sequences), uint8, and the first of each sequence among them."""
        n = len(self.start)
        which = np.repeat(self.first - (np.cumsum(self.length) - self.length), self.length) + np.arange(self.length.sum())
        # Only tokens near decoded ones need a shape.
        near = np.zeros(n, bool)
        for d in range(-2, 3):
            near[np.clip(which + d, 0, n - 1)] = True
        shape = np.full(n + 4, NONE, np.uint8)  # two on either side of the ends
        some = np.flatnonzero(near)
        shape[some + 2] = self._shape(some)
        gap = np.append(np.append(self.gap, [3, 3]), [3, 3]).astype(np.int64)

        def seen(d):
            """The shapes ``d`` tokens on, none beyond a break."""
            between = range(1, d + 1) if d > 0 else range(d + 1, 1)
            cut = np.zeros(len(which), bool)
            for b in between:
                cut |= gap[np.clip(which + b, 0, n)] == 3
            return np.where(cut, NONE, shape[which + d + 2]).astype(np.int64)

        out = np.empty((FEATURES, len(which)), np.uint8)
        out[0] = shape[which + 2].astype(np.int64) * 4 + gap[which]
        out[1] = seen(-1) * 4 + gap[which]
        out[2] = seen(1) * 4 + gap[which + 1]
        out[3] = seen(-2)
        out[4] = seen(2)
        out[5] = self._cue(which)
        out[6], out[7] = self._stretch(which)
        out[8] = self._word(which, shape, gap)
        return out

    def _shape(self, i: np.ndarray) -> np.ndarray:
        start, end = self.start[i], self.end[i]
        kind, size, head = self.kind[start], end - start, self.data[start]
        upper = np.append(0, np.cumsum((self.data >= 65) & (self.data < 91)))
        foreign = np.append(0, np.cumsum(self.data >= 128))
        ups, far = upper[end] - upper[start], foreign[end] - foreign[start]
        letters = np.select([far > 0, (ups == 1) & (head >= 65) & (head < 91) & (size > 1), ups == size, ups > 0, size == 1, size < 4], [6, 3, 4, 5, 0, 1], 2)
        digits = _DIGIT_SHAPE[np.minimum(size, 20)].astype(np.int64)
        third = np.minimum(start + 2, len(self.data) - 1)
        value = 100 * (head.astype(np.int64) - 48) + 10 * (self.data[np.minimum(start + 1, len(self.data) - 1)].astype(np.int64) - 48) + self.data[third] - 48
        digits = np.where((size == 3) & (value > 255), 11, digits)
        digits = np.where((size > 1) & (size < 5) & (head == 48), 24, digits)
        return np.where(kind == LETTER, letters, np.where(kind == DIGIT, digits, _MARK_SHAPE[head])).astype(np.uint8)

    def _cue(self, which: np.ndarray) -> np.ndarray:
        """The kind of the nearest cue word among the four tokens before, and whether it is one of the next two."""
        out = np.zeros(len(which), np.int64)
        for d in (4, 3, 2, 1):
            at = which - d
            ok = at >= 0
            at = np.maximum(at, 0)
            ok &= (self.text[at] == self.text[which]) & (self.kind[self.start[at]] == LETTER) & (self.end[at] - self.start[at] <= 9)
            i = np.flatnonzero(ok)
            value = np.zeros(len(i), np.uint64)
            for b in range(8):
                place = self.start[at[i]] + b
                inside = place < self.end[at[i]]
                byte = self.data[np.where(inside, place, 0)]
                byte = np.where((byte >= 65) & (byte < 91), byte + 32, byte)
                value |= np.where(inside, byte, 0).astype(np.uint64) << np.uint64(8 * b)
            slot = np.minimum(np.searchsorted(_CUE_WORDS, value), len(_CUE_WORDS) - 1)
            hit = _CUE_WORDS[slot] == value
            out[i[hit]] = _CUE_KIND[slot[hit]] + (len(KINDS) if d > 2 else 0)
        return out

    def _stretch(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digits of the stretch of digits and marks around a token with a plus before it, and its digit groups."""
        if not len(which):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        head = self.data[self.start[which]]
        digit = self.kind[self.start[which]] == DIGIT
        member = digit | _STRETCH[head]
        joint = np.zeros(len(which), bool)  # goes on the stretch of the token before
        joint[1:] = member[1:] & member[:-1] & (which[1:] == which[:-1] + 1) & (self.gap[which[1:]] < 3)
        begin = np.flatnonzero(~joint)
        of = np.cumsum(~joint) - 1
        size = np.where(digit, self.end[which] - self.start[which], 0)
        total = np.add.reduceat(size, begin)
        groups = np.add.reduceat(digit.astype(np.int64), begin)
        plus = np.add.reduceat((head == 43).astype(np.int64), begin) > 0
        before = np.cumsum(digit) - digit
        before = before - before[begin][of]
        return (np.where(member, _DIGIT_SUM[np.minimum(total, 20)][of] * 2 + plus[of], 28),
                np.where(member, np.minimum(before, 7) * 8 + np.minimum(groups[of], 7), 64))

    def _word(self, which: np.ndarray, shape: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Bits: glued to letters or digits on either side, the word has an @, a dot, and stands behind an @."""
        at_sign, dot = (np.append(0, np.cumsum(self.data == c)) for c in (64, 46))
        word = np.flatnonzero(self.gap > 0)
        last = np.append(word[1:], len(self.start)) - 1
        a, b = self.start[word[self.word_of[which]]], self.end[last[self.word_of[which]]]
        left = (gap[which] == 0) & (shape[which + 1] < 25)
        right = (gap[which + 1] == 0) & (shape[which + 3] < 25)
        here = self.start[which]
        return (left + 2 * right + 4 * (at_sign[b] > at_sign[a]) + 8 * (dot[b] > dot[a]) + 16 * (at_sign[here] > at_sign[a])).astype(np.int64)


# ---------------------------------------------------------------- the field
def allowed() -> np.ndarray:
    """Which label may follow which: an inside label only its own begin or inside label."""
    ok = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


_FIRST = np.array([j == 0 or j % 2 == 1 for j in range(LABELS)])


class Field:
    """Weights of the features (FEATURES, 256, LABELS) and of neighbouring labels."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, np.where(allowed(), steps, -1e9)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum(self.weights[f][features[f]] for f in range(FEATURES))

    def viterbi(self, features: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The best labels of all tokens; sequences stand one after the other and are decoded side by side."""
        labels = np.zeros(features.shape[1], np.int64)
        if not len(length):
            return labels
        order = np.argsort(-length, kind="stable")
        size, first = length[order], (np.cumsum(length) - length)[order]
        best = self.scores(features[:, first]) + np.where(_FIRST, 0.0, -1e9)
        back, final = [], np.empty((len(size), LABELS))
        for t in range(1, int(size[0]) + 1):
            active = int(np.searchsorted(-size, -t, side="left"))  # longer than t
            final[active:len(best)] = best[active:]
            if not active:
                break
            ways = best[:active, :, None] + self.steps
            back.append(ways.argmax(axis=1).astype(np.int8))
            best = np.take_along_axis(ways, back[-1][:, None, :].astype(np.int64), 1)[:, 0] + self.scores(features[:, first[:active] + t])
        now = final.argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            active = int(np.searchsorted(-size, -t, side="left"))
            labels[first[:active] + t] = now[:active]
            if t:
                now[:active] = back[t - 1][np.arange(active), now[:active]]
        return labels

    def path(self, features: np.ndarray, labels: np.ndarray) -> float:
        """The score of a labelling of one sequence."""
        each = self.scores(features)[np.arange(len(labels)), labels].sum()
        return float(each + self.steps[labels[:-1], labels[1:]].sum())


def likelihood(weights, steps, features, length, labels):
    """Log likelihood of the labels, and its gradients by the expected counts of forward-backward."""
    order = np.argsort(-length, kind="stable")
    size, first = length[order], (np.cumsum(length) - length)[order]
    score = sum(weights[f][features[f]] for f in range(FEATURES))
    top = score.max(axis=1, keepdims=True)
    e = np.exp(score - top)
    move = np.where(allowed(), np.exp(steps), 0.0)
    n, longest = len(score), int(size[0])
    count = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]
    alpha, beta, norm = np.zeros((n, LABELS)), np.ones((n, LABELS)), np.zeros(n)
    for t in range(longest):
        at = first[:count[t]] + t
        a = e[at] * (_FIRST if t == 0 else alpha[at - 1] @ move)
        norm[at] = a.sum(axis=1)
        alpha[at] = a / norm[at, None]
    pairs = np.zeros((LABELS, LABELS))
    for t in range(longest - 1, 0, -1):
        at = first[:count[t]] + t
        b = e[at] * beta[at] / norm[at, None]
        beta[at - 1] = b @ move.T
        pairs += move * (alpha[at - 1].T @ b)
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    value = score[np.arange(n), labels].sum() + steps[labels[at - 1], labels[at]].sum() - (np.log(norm) + top[:, 0]).sum()
    left = -alpha * beta
    left[np.arange(n), labels] += 1
    np.add.at(pairs_seen := np.zeros_like(pairs), (labels[at - 1], labels[at]), 1)
    grad = np.zeros_like(weights)
    for f in range(FEATURES):
        np.add.at(grad[f], features[f], left)
    return value, grad, pairs_seen - pairs


def labelled(lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, lengths and labels of the decoded sequences of lines of (piece, kind or None)."""
    texts = ["".join(p for p, _ in line).encode() for line in lines]
    off = np.cumsum([0, *map(len, texts)])
    tokens = Tokens(np.frombuffer(b"".join(texts), np.uint8), off)
    mark = np.zeros(int(off[-1]), np.int64)
    for line, at in zip(lines, off.tolist()):
        for piece, kind in line:
            size = len(piece.encode())
            if kind is not None and size:
                mark[at:at + size] = 2 + 2 * KINDS.index(kind)
                mark[at] = 1 + 2 * KINDS.index(kind)
            at += size
    labels = mark[tokens.start]
    which = np.concatenate([np.arange(a, a + k) for a, k in zip(tokens.first, tokens.length)]) if len(tokens.first) else np.zeros(0, np.int64)
    return tokens.features(), tokens.length, labels[which]


def train(lines, steps: int = STEPS) -> Field:
    """Fit the field to lines of (piece, kind or None): Adam on the log likelihood per sequence, less a small square."""
    features, length, labels = labelled(lines)
    state = [np.zeros((FEATURES, 256, LABELS)), np.zeros((LABELS, LABELS))]
    if not len(length):
        return Field(*state)
    m, v = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    for t in range(1, steps + 1):
        _, *grad = likelihood(*state, features, length, labels)
        for i, g in enumerate(grad):
            g = g / len(length) - SHRINK * state[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            state[i] = state[i] + RATE * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.99 ** t)) + 1e-8)
    return Field(*state)


def labelled_table(spark: SparkSession, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """(row, pieces): the labelled table of the query; a piece has a text and, if it is personal data, a kind."""
    lines = labelled_lines(rows, seed)
    return spark.createDataFrame(list(enumerate(lines)), "row long, pieces array<struct<piece:string,kind:string>>")


def fit(labelled_rows: DataFrame, row: str = "row", pieces: str = "pieces") -> Field:
    """Train on a labelled table: its first ``LABELLED_ROWS`` rows by number."""
    some = labelled_rows.orderBy(row).limit(LABELLED_ROWS).select(pieces).collect()
    return train([[(p["piece"], p["kind"]) for p in r[0] or []] for r in some])


# ---------------------------------------------------------------- spans
_AT = re.compile(r"@|[(\[]at[)\]]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\(dot\)|\[\.\])[A-Za-z0-9-]+)*(?:\.|\(dot\)|\[\.\])[A-Za-z]{2,}")
_GROUP = re.compile(r"[0-9]+")


def plausible(kind: str, span: str) -> bool:
    digits = "".join(_DIGITS.findall(span))
    if kind == "email":
        local, at, host = (lambda m: (span[:m.start()], m, span[m.end():]) if m else ("", None, ""))(_AT.search(span))
        return at is not None and bool(re.fullmatch(r"[\w.%+-]+\s?", local)) and bool(_HOST.fullmatch(host.strip()))
    if kind == "ip":
        parts = _GROUP.findall(span)
        if ":" in span:
            try:
                return ipaddress.ip_address(span).version == 6
            except ValueError:
                return False
        return len(parts) == 4 and all(map(_small, parts)) and not re.search(r"[A-Za-z]", span) and len(re.findall(r"\.", span)) == 3
    if re.search(r"[^\W\d_]", span):
        return False
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(_GROUP.findall(span)) > 1


def added_spans(field: Field, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Per text (its place): the (start, kind, end) that the field finds, in code points, in order."""
    tokens = Tokens(data, off)
    if not len(tokens.first):
        return {}
    features = tokens.features()
    labels = field.viterbi(features, tokens.length)
    out: dict[int, list] = {}
    begin = np.cumsum(tokens.length) - tokens.length
    where = np.repeat(tokens.first - begin, tokens.length) + np.arange(len(labels))
    sequence = np.repeat(np.arange(len(begin)), tokens.length)
    points: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(labels % 2 == 1).tolist():
        s = int(sequence[i])
        a, b = int(begin[s]), int(begin[s] + tokens.length[s])
        j = i + 1
        while j < b and labels[j] == labels[i] + 1:
            j += 1
        without = labels[a:b].copy()
        without[i - a:j - a] = 0
        lead = field.path(features[:, a:b], labels[a:b]) - field.path(features[:, a:b], without)
        start, end, text = int(tokens.start[where[i]]), int(tokens.end[where[j - 1]]), int(tokens.text[where[i]])
        kind = int(labels[i] - 1) // 2
        before = start > off[text] and _CLASS[data[start - 1]] in (LETTER, DIGIT)
        after = end < off[text + 1] and _CLASS[data[end]] in (LETTER, DIGIT)
        if lead < MARGIN or before or after or not plausible(KINDS[kind], data[start:end].tobytes().decode()):
            continue
        if text not in points:
            points[text] = np.append(0, np.cumsum((data[off[text]:off[text + 1]] & 0xC0) != 0x80))
        at = points[text]
        out.setdefault(text, []).append((int(at[start - off[text]]), kind, int(at[end - off[text]])))
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def _found(field: Field):
    def named(spans):
        return [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]

    def run(batches):
        for batch in batches:
            base, spans = [], []
            for _, _, data, off in text_chunks(batch.column(1)):
                extra = added_spans(field, data, off)
                raw = data.tobytes()
                hint = np.append(0, np.cumsum((_CLASS[data] == DIGIT) | (data == 64)))
                some = hint[off[1:]] > hint[off[:-1]]
                for i in range(len(off) - 1):
                    found = base_spans(raw[off[i]:off[i + 1]].decode()) if some[i] else []
                    new = [x for x in extra.get(i, ()) if all(x[2] <= b[0] or b[2] <= x[0] for b in found)]
                    base.append(named(found))
                    spans.append(named(sorted(found + new)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPAN), pa.array(spans, _SPAN)], ["key", "base", "spans"])

    return run


def find_personal(df: DataFrame, key: str, text: str, field: Field) -> DataFrame:
    """(key, base, spans): arrays of (start, kind, end) in code points, in order of start and kind."""
    rows = ensure_parallelism(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")))
    one = "array<struct<start:long,kind:string,end:long>>"
    return map_arrow(rows, _found(field), keyed_schema(rows, "key", f"base {one}, spans {one}")).withColumnRenamed("key", key)


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document."""
    found = find_personal(table(spark, sf_dir, "documents"), "doc_id", "text", fit(labelled_table(spark)))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
                        (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
