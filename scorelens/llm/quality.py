"""Quality rules: an isolation forest over rule statistics.

``statistics`` counts the rules' figures of each whole text: shares of words and lines, unbounded and as they are. They are
standardised by what is usual: the median and the 99 % quantile of the distance from it, both among all labelled good rows (without
those, among all rows the base rule leaves), the quantile being one word of a usual text at least. A forest of random splits is grown from
rows the base rule leaves, ``sample`` a tree, as an isolation forest is defined; a split takes a figure with a probability in proportion to the range it still has,
so a figure that is rarely unusual counts when it is. Each document gets an average path length: the fewer splits isolate it, the
more anomalous it is. The threshold alone decides, calibrated on all labelled rows: of all cuts
that lose at most ``max_good_loss`` of the good ones, the one that catches most bad ones.

The figures of all texts are counted once and stored; medians, quantiles and the threshold are exact order statistics of
all their rows, found by counts. The trees' rows, ``trees * sample`` as expected, are chosen by a hash of the id (a
share of the counted rows), so what the driver grows stays small at every input size.

Defined results: null text has no words and fails the base rule; without labelled good rows
nothing is rejected beyond the base rule; without labelled bad rows the cut loses none of
the good ones, and rejects nothing if these are too few (under 1 / max_good_loss) to tell; label rows with nulls are ignored; an id labelled both ways counts as
good. Repeated rows come back as given; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import SPACES, id_text, map_batches, sliced, stored
from scorelens.llm.ranks import order_statistics

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
TREES, SAMPLE, MAX_GOOD_LOSS, SEED = 100, 256, 0.002, 7
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares of the words: all capitals, two marks in a row, marks alone, symbols, equal to the one before; code points a word;
#: shares of the lines that repeat one, and of the words that lie in repeated windows.
FEATURES = ("capitals", "marks", "wordless", "symbols", "echoes", "word_length", "dup_lines", "repeats")
USUAL = 0.99  # of good rows lie within the unit of a standardised figure

_SPACE, _MARK, _UPPER, _LOWER = 1, 2, 4, 8
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[ord(c) for c in SPACES]] = _SPACE
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = _MARK
_CLASS[65:91], _CLASS[97:123] = _UPPER, _LOWER


def word_shares(data: bytes) -> tuple[float, float, float]:
    """Shares of the words that are all capitals (two bytes or more), hold two marks in a row, are marks alone."""
    kind = np.concatenate([[_SPACE], _CLASS[np.frombuffer(data, dtype=np.uint8)], [_SPACE]]).astype(np.uint8)
    edges = np.flatnonzero(np.diff((kind == _SPACE).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return 0.0, 0.0, 0.0

    def within(flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each word has."""
        before = np.cumsum(flags, dtype=np.int32)
        return before[ends] - before[starts]

    marks = kind == _MARK
    pairs = np.concatenate([[False], marks[1:] & marks[:-1]])
    length = ends - starts
    capitals = (within(kind == _UPPER) > 0) & (within(kind == _LOWER) == 0) & (length > 1)
    return float(capitals.mean()), float((within(pairs) > 0).mean()), float((within(marks) == length).mean())


def repeated_words(words: list[bytes], window: int = WINDOW, hashes: np.ndarray | None = None) -> int:
    """How many words lie in windows of ``window`` words that occur twice or more."""
    if len(words) <= window:
        return 0
    hashes = word_hashes(words) if hashes is None else hashes
    mixed = np.zeros(len(words) - window + 1, dtype=np.uint64)
    for k in range(window):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += hashes[k:k + len(mixed)]
    inorder = np.sort(mixed)
    twice = inorder[1:][inorder[1:] == inorder[:-1]]
    if not len(twice):  # equal windows have equal hashes
        return 0
    number: dict[bytes, int] = {}  # now compare the words themselves
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32)
    maybe = np.flatnonzero(np.isin(mixed, twice))
    _, where, times = np.unique(ids[maybe[:, None] + np.arange(window)], axis=0, return_inverse=True, return_counts=True)
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = maybe[times[where.ravel()] > 1]
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes that hold within one process: to compare the words of one text."""
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)


def rule_statistics(text: str) -> tuple:
    """The counts of COUNTS, then the figures of FEATURES."""
    data = text.encode()
    words = data.split()  # of bytes: at the six ASCII spaces only
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    hashes = word_hashes(words)
    of, dup, repeated = max(n, 1), len(lines) - len(set(lines)), repeated_words(words, WINDOW, hashes)
    return (n, chars, symbols, dup, repeated,
            *word_shares(data), symbols / of, int((hashes[1:] == hashes[:-1]).sum()) / of, chars / of, dup / max(1, len(lines)), repeated / of)


class IsolationForest:
    """Trees of random splits in flat arrays; ``depth`` is the average path length of each row.

    Rows are standardised by ``centre`` and ``spread`` first; a split takes a column with a probability in proportion to its range.
    """

    def __init__(self, rows: np.ndarray, trees: int, sample: int, seed: int, centre: np.ndarray | float = 0.0, spread: np.ndarray | float = 1.0):
        rng, self.trees, self.centre, self.spread = np.random.default_rng(seed), [], centre, spread
        rows = (rows - centre) / spread
        size = min(sample, len(rows))
        levels = max(1, int(np.ceil(np.log2(max(size, 2)))))
        for _ in range(trees):
            self.trees.append(self._grow(rows[rng.permutation(len(rows))[:size]], levels, rng))

    @staticmethod
    def expected(n: int) -> float:
        """Average path length of an unsuccessful search among ``n`` rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, levels: int, rng: np.random.Generator) -> tuple:
        feature, cut, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, level: int) -> int:
            at = len(feature)
            for column, value in ((feature, 0), (cut, np.inf), (left, at), (right, at), (path, level + self.expected(len(part)))):
                column.append(value)
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            if level < levels and (high > low).any():
                k = int(rng.choice(len(low), p=(high - low) / (high - low).sum()))
                feature[at], cut[at] = k, rng.uniform(low[k], high[k])
                left[at] = node(part[part[:, k] < cut[at]], level + 1)
                right[at] = node(part[part[:, k] >= cut[at]], level + 1)
            return at

        node(rows, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(path), levels

    def depth(self, rows: np.ndarray) -> np.ndarray:
        rows, total = (rows - self.centre) / self.spread, np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, cut, left, right, path, levels in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(levels):
                at = np.where(rows[each, feature[at]] < cut[at], left[at], right[at])
            total += path[at]
        return total / max(1, len(self.trees))


def calibrated(good: np.ndarray, bad: np.ndarray, max_good_loss: float) -> float:
    """The path length below which rows are rejected; -inf rejects none. ``threshold`` finds the same in tables of any size."""
    if not len(good):
        return -np.inf
    good = np.sort(good)
    most = good[min(len(good) - 1, int(max_good_loss * len(good)))]  # rows strictly below it: the loss allowed
    if not len(bad):  # below the least of n good rows 1 / (n + 1) of all good ones are expected
        return float(good[0]) if (len(good) + 1) * max_good_loss >= 1 else -np.inf
    cuts = np.append(good[good <= most], most)
    caught = np.searchsorted(np.sort(bad), cuts, side="left")
    return float(cuts[np.flatnonzero(caught == caught.max())[0]])


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, FEATURES, base_failed) for each row."""
    rows = id_text(df, id_col, text_col)

    def apply(c):
        figures = list(zip(*map(rule_statistics, c["text"]))) or [[]] * (len(COUNTS) + len(FEATURES))
        return {"id": c["id"], **dict(zip(COUNTS + FEATURES, figures))}

    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *(f"{c} long" for c in COUNTS),
                        *(f"{c} double" for c in FEATURES)])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return map_batches(rows, lambda: apply, schema).withColumn("base_failed", failed)


def path_length(forest: IsolationForest | None) -> Column:
    """The path length of a row with FEATURES; 0 without a forest."""
    @F.arrow_udf("double")
    def depth(*columns):
        return pa.array(forest.depth(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)), pa.float64())

    return depth(*map(F.col, FEATURES)) if forest else F.lit(0.0)


def fit(figures: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", trees: int = TREES, sample: int = SAMPLE,
        max_good_loss: float = MAX_GOOD_LOSS, seed: int = SEED) -> tuple[IsolationForest | None, float]:
    """The forest, grown from ``sample`` rows a tree of those that the base rule leaves, and its threshold from all labelled ones.

    ``figures``: the stored ``statistics`` of all rows.
    """
    left = figures.where(~F.col("base_failed")).select("id", "n_words", *FEATURES)
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11).cast("double") / float(1 << 53)
    n, columns = trees * sample, ["n_words", *FEATURES]
    chosen = left.where(order < n / max(1, figures.count())).select(*columns)
    grown_from = chosen.orderBy(*columns).limit(2 * n).collect()  # as many only if an id repeats very often
    if not grown_from:
        return None, -np.inf
    usual = marked = None
    if labels is not None:
        marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col("quality").cast("int").alias("good")).dropna().groupBy("id").agg(F.max("good").alias("good"))
        marked = stored(left.join(marks, "id"), "quality_marked")
        usual = marked.where("good = 1")
    if usual is None or usual.isEmpty():
        usual = left
    rows = np.array([[r[f] for f in FEATURES] for r in grown_from], dtype=float).reshape(-1, len(FEATURES))
    forest = IsolationForest(rows, trees, sample, seed, *standard(usual))
    if marked is None:
        return forest, -np.inf
    return forest, threshold(stored(marked.select("good", path_length(forest).alias("path_length")), "quality_paths"), max_good_loss)


def standard(usual: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What is usual: the rows' median, and how far from it USUAL of them lie (one word of a usual text at least)."""
    n, names = usual.count(), [*FEATURES, "n_words"]

    def ranked(columns: list[Column], low: int, high: int) -> np.ndarray:
        """The values at two ranks, a row each."""
        found = order_statistics(usual.select(F.posexplode(F.array(*columns)).alias("name", "value")), {k: [low, high] for k in range(len(columns))})
        return np.array([[found[k, rank] for k in range(len(columns))] for rank in (low, high)])

    middle = np.median(ranked([F.col(c).cast("double") for c in names], (n - 1) // 2, n // 2), axis=0)
    centre, at = middle[:-1], (n - 1) * USUAL
    low = int(at)
    ends = ranked([F.abs(F.col(c) - F.lit(float(m))) for c, m in zip(FEATURES, centre)], low, min(low + 1, n - 1))
    return centre, np.maximum(np.quantile(ends, at - low, axis=0), 1.0 / max(1.0, float(middle[-1])))


def threshold(paths: DataFrame, max_good_loss: float) -> float:
    """``calibrated`` of the path lengths of all labelled rows (good int, path_length)."""
    good, bad = (paths.where(F.col("good") == 1).select(F.lit(0).alias("name"), F.col("path_length").alias("value")),
                 paths.where(F.col("good") != 1).select(F.col("path_length").alias("value")))
    n, least = good.agg(F.count("*"), F.min("value")).first()
    if not n:
        return -np.inf
    if bad.isEmpty():  # below the least of n good rows 1 / (n + 1) of all good ones are expected
        return float(least) if (n + 1) * max_good_loss >= 1 else -np.inf
    rank = min(n - 1, int(max_good_loss * n))  # rows strictly below it: the loss allowed
    most = order_statistics(good, {0: [rank]})[0, rank]
    last = bad.where(F.col("value") < most).agg(F.max("value")).first()[0]  # the last bad row that any cut allowed catches
    return float(least if last is None else good.where(F.col("value") > last).agg(F.min("value")).first()[0])


def judge(df: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """(id, COUNTS, FEATURES, path_length, base_failed, kept) for each row of ``df``.

    ``labels``: (id_col, quality 0 or 1), or None.
    """
    figures = stored(statistics(df, id_col, text_col), "quality_figures")
    forest, cut = fit(figures, labels, id_col, **bounds)
    return (figures.select("id", *COUNTS, *FEATURES, path_length(forest).alias("path_length"), "base_failed")
            .withColumn("kept", ~F.col("base_failed") & (F.col("path_length") >= F.lit(float(cut)))))


def keep_good(df: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, whole."""
    forest, cut = fit(stored(statistics(df, id_col, text_col), "quality_figures"), labels, id_col, **bounds)

    @F.arrow_udf("boolean")
    def kept(texts):
        out = []
        for part in sliced(texts):
            figures = np.array([rule_statistics(t or "") for t in part], dtype=float).reshape(-1, len(COUNTS) + len(FEATURES))
            failed = (figures[:, 0] < MIN_WORDS) | (100 * figures[:, COUNTS.index("n_repeat_words")] > MAX_REPEAT_PERCENT * figures[:, 0])
            out.append(~failed & (forest.depth(figures[:, len(COUNTS):]) >= cut if forest else True))
        return pa.array(np.concatenate([*out, np.zeros(0, bool)]), pa.bool_())

    return df.where(kept(F.col(f"`{text_col}`")))
