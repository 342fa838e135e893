"""Operator 12: spelling variants by composing the vocabulary's acceptor with a one-edit transducer.

Two words are near if one inserted, deleted or replaced code point turns one
into the other.  Near pairs are the paths of the composition A * E * A, where
A is the minimised acceptor of the vocabulary and E the transducer of exactly
one edit.  A path runs through both copies of A in step, takes the edit at
the first place where the words differ (so each pair has one path only), and
goes on in step to the end.  The composition is built over pairs of states,
pairs from which no word end can be reached are trimmed, and the paths that
are left are enumerated; numbers of words on the arcs of A turn a path into
the places of its two words.

The vocabulary is dealt out by initial states.  For a pair whose shorter word
has m code points, let h = m // 2.  Either both words begin with the same h
code points, and A starts in the state behind them; or they end with the same
m - h code points, and the mirrored acceptor starts in the state behind those.
So each word of length L goes to four initial states (m = L and L - 1, both
directions), of which each holds only words of two lengths that share half
their letters.  Many initial states are handled in one array program, cut into
chunks of about ``CHUNK`` words between initial states.

On Spark: the texts are read once; each task counts its words in a table of
bounded size and one shuffle on the word sums them.  The vocabulary is
written.  A second shuffle deals its words by initial state, and what comes
back is one row per word and initial state: the number of near words and the
best of them.  Roots are found by pointer doubling, where each round halves
the chains; as a form has at least twice its word's count, chains are never
longer than the logarithm of the largest count.

Defined cases: a null text has no words; a null id counts as the empty string
where the id is hashed; repeated rows count each time; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm.common import flat_text, map_arrow, table
from grantlens.plans.materialize import written
from grantlens.session import ensure_parallelism

#: The letters of a run (A-Z are lower-cased first), the least code points and counts of a word.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many, by the checksum of id and run, loses a code point.
DAMAGE = 97
#: A near word becomes the form of a word with at most 1/RATIO of its count.
RATIO = 2
#: Words of one task's table of counts; words composed at once.
HELD_WORDS, CHUNK = 1 << 18, 20_000
LONG_TEXT = 1 << 22


# ---------------------------------------------------------------- words
def _counted(least: int, damage: int):
    run = re.compile(f"[{LETTERS}]{{{least},}}")

    def counts_of(batches):
        held: dict[str, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            data, off = flat_text(batch.column(1))
            raw = data.tobytes().lower()  # of bytes: only A-Z
            for key, (a, b) in zip(batch.column(0).to_pylist(), itertools.pairwise(off.tolist())):
                text = raw[a:b].decode()
                found = Counter(run.findall(text) if b - a < LONG_TEXT else (m[0] for m in run.finditer(text)))
                seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in found.items():
                    if damage:
                        h = zlib.crc32(word.encode(), seed)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held = {}
        if held:
            yield rows()

    return counts_of


def vocabulary(df: DataFrame, key: str, text: str, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               damage: int = 0) -> DataFrame:
    """(word, n): runs of letters of at least ``least_length`` code points met at least ``least_count`` times.

    With ``damage``, a run whose checksum of "<key>:<run>" it divides loses one code point before it is counted.
    """
    rows = ensure_parallelism(df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text")))
    counts = map_arrow(rows, _counted(least_length, damage), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- acceptors and composition
def ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and entries of the runs start..start+count-1."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + start[row]


class Acceptor:
    """The minimised acceptor of words of one length, one initial state per group.

    ``codes`` has one row per word, sorted by group and then by code points.
    Layer d holds the states reached after d code points; the arcs of a state
    stand together, in the order of their labels, and ``skip`` is the number
    of the state's words that come before the arc's.
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        n, self.depth = codes.shape
        same = group[1:] == group[:-1]
        common = np.where(same, np.cumprod(codes[1:] == codes[:-1], axis=1, dtype=np.int64).sum(axis=1), -1)
        #: First words of the nodes of each layer of the trie.
        first = [np.concatenate([[0], np.flatnonzero(common < d) + 1]) for d in range(self.depth + 1)]
        state = np.zeros(len(first[-1]), np.int64)  # in the last layer all nodes are the one final state
        words = np.ones(1, np.int64)
        self.layers: list = [None] * self.depth
        for d in range(self.depth - 1, -1, -1):
            child = np.searchsorted(first[d + 1], first[d])
            ends = np.append(child[1:], len(first[d + 1]))
            label = codes[first[d + 1], d].astype(np.int64)
            sign = label << 32 | state
            raw, known, of = sign.tobytes(), {}, np.empty(len(child), np.int64)
            kept = []
            for i, (a, b) in enumerate(zip((child * 8).tolist(), (ends * 8).tolist())):
                s = known.setdefault(raw[a:b], len(kept))
                if s == len(kept):
                    kept.append(i)
                of[i] = s
            kept = np.array(kept)
            degree = ends[kept] - child[kept]
            row, arc = ranges(child[kept], degree)
            begin = np.append(0, np.cumsum(degree))
            below = words[state[arc]]
            skip = np.cumsum(below) - below
            self.layers[d] = (begin, label[arc], state[arc], skip - skip[begin[:-1]][row], row << 21 | label[arc])
            words = np.add.reduceat(below, begin[:-1])
            state = of
        #: The initial state, first word and group of every group.
        self.initial, self.base, self.group = state, first[0], group[first[0]]

    def arcs(self, d: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.layers[d][0]
        return ranges(begin[state], begin[state + 1] - begin[state])

    def find(self, d: int, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have an arc with the label, and its number."""
        keys, want = self.layers[d][4], state << 21 | label
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return keys[at] == want, at


class Pairs:
    """The composition behind the edit: pairs of states reached, layer by layer, trimmed from the end.

    The first copy of the acceptor is ``ahead`` layers further on than the second.
    """

    def __init__(self, one: Acceptor, two: Acceptor, ahead: int):
        self.one, self.two, self.ahead = one, two, ahead
        self.reached: list = [np.zeros(0, np.int64)] * (two.depth + 1)

    def step(self, d: int, x: np.ndarray, y: np.ndarray, but: np.ndarray | None = None):
        """Rows, and the arcs of both, of all steps with one label; ``but`` names a label not to be taken."""
        row, arc = self.one.arcs(d + self.ahead, x)
        label = self.one.layers[d + self.ahead][1][arc]
        has, other = self.two.find(d, y[row], label)
        if but is not None:
            has &= label != but[row]
        return row[has], arc[has], other[has]

    def targets(self, d: int, arc: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.one.layers[d + self.ahead][2][arc], self.two.layers[d][2][other]

    def add(self, d: int, x: np.ndarray, y: np.ndarray) -> None:
        self.reached[d] = np.union1d(self.reached[d], x << 32 | y)

    def trim(self) -> None:
        """Follow all pairs to the end, then keep those that get there."""
        moves: list = [None] * self.two.depth
        for d in range(self.two.depth):
            pairs = self.reached[d]
            row, arc, other = self.step(d, pairs >> 32, pairs & 0xFFFFFFFF)
            x, y = self.targets(d, arc, other)
            self.add(d + 1, x, y)
            moves[d] = row, x << 32 | y
        for d in range(self.two.depth - 1, -1, -1):
            row, to = moves[d]
            good = np.zeros(len(self.reached[d]), bool)
            good[row[np.isin(to, self.reached[d + 1])]] = True
            self.reached[d] = self.reached[d][good]

    def paths(self, d: int, x, i, y, j) -> tuple[np.ndarray, np.ndarray]:
        """Words of both at the ends of all paths from the given pairs (state and first word of each)."""
        while True:
            good = np.isin(x << 32 | y, self.reached[d])
            x, i, y, j = x[good], i[good], y[good], j[good]
            if d == self.two.depth:
                return i, j
            row, arc, other = self.step(d, x, y)
            i, j = i[row] + self.one.layers[d + self.ahead][3][arc], j[row] + self.two.layers[d][3][other]
            x, y = self.targets(d, arc, other)
            d += 1


def replaced(a: Acceptor) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words that differ in one code point."""
    def two_arcs(d, state):
        begin = a.layers[d][0]
        row, arc = a.arcs(d, state)
        again, other = ranges(arc + 1, begin[state + 1][row] - arc - 1)
        return row[again], arc[again], other

    pairs = Pairs(a, a, 0)
    for d in range(a.depth):
        _, arc, other = two_arcs(d, np.arange(len(a.layers[d][0]) - 1))
        pairs.add(d + 1, *pairs.targets(d, arc, other))
    pairs.trim()
    out = []
    state, word = a.initial, a.base
    for d in range(a.depth):
        _, _, target, skip, _ = a.layers[d]
        row, arc, other = two_arcs(d, state)
        out.append(pairs.paths(d + 1, target[arc], word[row] + skip[arc], target[other], word[row] + skip[other]))
        row, arc = a.arcs(d, state)
        state, word = target[arc], word[row] + skip[arc]
    return tuple(np.concatenate(c) for c in zip(*out))


def shortened(long: Acceptor, short: Acceptor) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a long and a short word, one code point less."""
    groups, g, h = np.intersect1d(long.group, short.group, return_indices=True)
    if not len(groups):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = Pairs(long, short, 0), Pairs(long, short, 1)

    def edit(d, x, y):
        """The arc that only the long word takes, then one step of both with another label."""
        row, gone = long.arcs(d, x)
        label, target = long.layers[d][1][gone], long.layers[d][2][gone]
        if d == short.depth:
            return row, gone, None, None
        again, arc, other = after.step(d, target, y[row], label)
        return row[again], gone[again], arc, other

    x, y = long.initial[g], short.initial[h]
    for d in range(short.depth + 1):
        both = np.unique(x << 32 | y)
        x, y = both >> 32, both & 0xFFFFFFFF
        _, gone, arc, other = edit(d, x, y)
        if arc is None:
            after.add(d, long.layers[d][2][gone], np.zeros(len(gone), np.int64))
        else:
            after.add(d + 1, *after.targets(d, arc, other))
            _, arc, other = before.step(d, x, y)
            x, y = before.targets(d, arc, other)
    after.trim()
    out = []
    x, i, y, j = long.initial[g], long.base[g], short.initial[h], short.base[h]
    for d in range(short.depth + 1):
        row, gone, arc, other = edit(d, x, y)
        at = i[row] + long.layers[d][3][gone]
        if arc is None:
            out.append((at, j[row]))
            break
        to, with_ = after.targets(d, arc, other)
        out.append(after.paths(d + 1, to, at + long.layers[d + 1][3][arc], with_, j[row] + short.layers[d][3][other]))
        row, arc, other = before.step(d, x, y)
        i, j = i[row] + long.layers[d][3][arc], j[row] + short.layers[d][3][other]
        x, y = before.targets(d, arc, other)
    return tuple(np.concatenate(c) for c in zip(*out))


def near_in(shorter: int, mirrored: bool, group: np.ndarray, rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in ``rest``) of near words of some initial states, whose shorter word has ``shorter`` code points.

    ``rest`` are the words behind their initial states, sorted inside each group.  Pairs that share the first
    half are left to the other direction when ``mirrored``.
    """
    half = shorter // 2
    depth = half if mirrored else shorter - half
    length = np.fromiter(map(len, rest), np.int64, len(rest))
    made, place, codes = {}, {}, {}
    for k in (depth, depth + 1):
        place[k] = np.flatnonzero(length == k)
        if len(place[k]):
            codes[k] = np.array([rest[i] for i in place[k].tolist()], dtype=f"<U{k}").view(np.uint32).reshape(-1, k)
            made[k] = Acceptor(group[place[k]], codes[k])
    none = np.zeros(0, np.int64)
    a, b = replaced(made[depth]) if depth in made else (none, none)
    out = [(place[depth][a], place[depth][b])]
    if len(made) == 2:
        a, b = shortened(made[depth + 1], made[depth])
        if mirrored:
            apart = (codes[depth + 1][a, 1:] != codes[depth][b]).any(axis=1)
            a, b = a[apart], b[apart]
        out.append((place[depth + 1][a], place[depth][b]))
    return tuple(np.concatenate(c) for c in zip(*out))


# ---------------------------------------------------------------- jobs
def by_initial_state(vocab: DataFrame) -> DataFrame:
    """(shorter, mirrored, start, rest, n): each word behind its four initial states, sorted inside each."""
    size = F.length("word")
    many = vocab.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("shorter"))
    half = F.floor(F.col("shorter") / 2).cast("int")
    ways = F.array(
        F.struct(F.lit(False).alias("mirrored"), F.col("word").substr(F.lit(1), half).alias("start"),
                 F.col("word").substr(half + 1, F.col("size")).alias("rest")),
        F.struct(F.lit(True).alias("mirrored"), F.reverse("word").substr(F.lit(1), F.col("shorter") - half).alias("start"),
                 F.reverse("word").substr(F.col("shorter") - half + 1, F.col("size")).alias("rest")))
    keys = ["shorter", "mirrored", "start"]
    parts = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (many.select("shorter", F.explode(ways).alias("way"), "n").select("shorter", "way.*", "n")
            .repartition(parts, *keys).sortWithinPartitions(*keys, "rest"))


def _composed(answer):
    def run(batches):
        held, size, limit = [], 0, 2 * CHUNK

        def chunk(part: pa.Table):
            start, rest = part.column("start").to_pylist(), part.column("rest").to_pylist()
            group = np.cumsum([0, *(a != b for a, b in itertools.pairwise(start))])
            shorter, mirrored = part.column("shorter")[0].as_py(), part.column("mirrored")[0].as_py()
            a, b = near_in(shorter, mirrored, group, rest)
            words = [(s + r)[::-1] if mirrored else s + r for s, r in zip(start, rest)]
            return answer(words, part.column("n").to_numpy(), a, b)

        def chunks(part: pa.Table, last: bool):
            """Chunks of whole initial states of one length and direction, and what is left."""
            keys = list(zip(*(part.column(c).to_pylist() for c in ("shorter", "mirrored", "start"))))
            begin = 0
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for i, at in enumerate(ends):
                following = ends[i + 1] if i + 1 < len(ends) else len(keys)
                if keys[at][:2] != keys[at - 1][:2] or following - begin > CHUNK:
                    yield chunk(part.slice(begin, at - begin))
                    begin = at
            if last and len(keys):
                yield chunk(part.slice(begin))
                begin = len(keys)
            rest.append(part.slice(begin))

        rest: list = []
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                yield from chunks(pa.Table.from_batches(held), False)
                held, size = rest[-1].to_batches(), rest[-1].num_rows
                limit = 2 * max(size, CHUNK)
                rest.clear()
        if held:
            yield from chunks(pa.Table.from_batches(held), True)

    return run


def _as_pairs(words, n, a, b):
    word = np.array(words, dtype=object)
    return pa.RecordBatch.from_arrays([pa.array(word[a], pa.string()), pa.array(word[b], pa.string())], ["a", "b"])


def _as_best(words, n, a, b):
    """Each word's number of near words and the one of largest n, the smallest of ties."""
    word, near = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words))] = np.arange(len(words))
    order = np.lexsort((rank[near], -n[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    text = np.array(words, dtype=object)
    return pa.RecordBatch.from_arrays(
        [pa.array(text[word[first]], pa.string()), pa.array(np.diff(np.append(first, len(word))), pa.int64()),
         pa.array(n[near[first]], pa.int64()), pa.array(text[near[first]], pa.string())], ["word", "n_near", "best_n", "best"])


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(a, b): every pair of near words of a vocabulary (word, n), once."""
    return map_arrow(by_initial_state(vocab), _composed(_as_pairs), "a string, b string")


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near word; pairs never leave their task."""
    found = map_arrow(by_initial_state(vocab), _composed(_as_best), "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("_b")).select(
        "word", "n_near", (-F.col("_b.less")).alias("best_n"), F.col("_b.best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form), none null: the last word that the forms lead to."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        now = written(now.join(ahead, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "spelling-roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    Words have three code points or more, and ``ratio`` is above 1, so that forms never lead back.
    """
    vocab = written(vocab.select("word", "n"), "spelling-vocabulary")
    found = vocab.join(near_words(vocab), "word", "left")
    form = F.col("best_n") >= ratio * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form"),
                                 F.when(form, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = with_roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    return variants(vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text", damage=DAMAGE))
