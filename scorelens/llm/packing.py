"""Best-fit packing of token sequences by a linear grouping scheme.

1. Texts become token ids once; a document of more than ``capacity`` tokens is cut into pieces of that size, its
   first piece taking what is left over.
2. Only the histogram of piece lengths (at most ``capacity`` counts, whatever the input) reaches
   the driver. Lengths above ``capacity / small`` are sorted into groups of equal cardinality and rounded up
   to the longest of their group.
3. Column generation over the few rounded sizes solves the configuration program: which combinations of sizes
   fill a sequence, and how many of each.
4. Actual lengths replace the rounded ones in the configurations (rounded down to whole numbers of
   sequences); what is left, and the small pieces, are placed by best fit, longest first, in runs of equal lengths.
5. The plan says: of the pieces of length L, ranks i to j go to sequences s, s+1, ... at offset o. Pieces are ranked
   within their length in parallel (salted, so one hot length is spread over tasks) and look their place up.

Defined results: null text counts as empty; an empty text is one piece, the closing id; repeated rows are packed
as often as given; rows without an id are packed too; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from itertools import chain
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelens.llm.common import id_text, kept, map_batches, stored

CAPACITY, END_ID, GROUPS, SMALL, MAX_COLUMNS = 2048, 0, 128, 8, 3000
PACKING = "packing"
CACHED_UNITS = 600_000  # a memory bound; forgotten units are encoded anew
JOINED = 256  # new units encoded as one string
RANK_ROWS = 50_000  # pieces of one length that one task ranks

# Tokens never reach over a space or line feed that follows a character other than white space, so a text may be
# encoded in units cut there, and each distinct unit once.
_UNITS, _ODD_SPACE, _STRICT = re.compile(r"[ \n]*[^ \n]+|[ \n]+"), re.compile(r"[^\S \n]"), re.compile(r"(?<=\S)(?=[ \n])")
_ASCII_ODD = [c for c in map(chr, range(128)) if _ODD_SPACE.match(c)]

_JOINT = frozenset(" \n")


def _odd(text: str) -> bool:
    """Whether there is white space other than spaces and line feeds."""
    return any(map(text.__contains__, _ASCII_ODD)) if text.isascii() else _ODD_SPACE.search(text) is not None


def _single(text: str) -> list[str] | None:
    """The units of a text whose white space is single spaces and line feeds between words, all but the first without their space; else None."""
    if text[:1].isspace() or text[-1:].isspace() or not text or _odd(text):
        return None
    apart = text.replace("\n", " \n")
    return None if "  " in apart or "\n " in apart else apart.split(" ")


class UnitEncoder:
    """A byte-level tokenizer with a bounded memory of units it has seen."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # units in texts with single spaces and line feeds, without their space
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)  # bytes of each token, a character each in its spelling
        self.sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        rest = [_single(t) for t in texts]  # None: no such text
        units = [(_STRICT.split(t) if _odd(t) else _UNITS.findall(t)) if r is None else r[:1] for t, r in zip(texts, rest)]
        self._learn(list(set(chain.from_iterable(units)) - self.known.keys()), self.known)
        for r in rest:
            if r is not None:
                del r[0]
        words = [r for r in rest if r is not None]
        found = [list(map(self.spaced.get, r)) for r in words]
        gaps = [[k for k, ids in enumerate(row) if ids is None] for row in found]
        new = {r[k] for r, row in zip(words, gaps) for k in row}
        self._learn([w for w in new if w[0] != "\n"], self.spaced, " ")
        self._learn([w for w in new if w[0] == "\n"], self.spaced)
        for r, row, missing in zip(words, found, gaps):
            for k in missing:
                row[k] = self.spaced[r[k]]
        known, following = self.known.__getitem__, iter(found)
        out = [np.frombuffer(b"".join(chain(map(known, u), () if r is None else next(following))), dtype="<u4") for u, r in zip(units, rest)]
        if len(self.known) + len(self.spaced) > CACHED_UNITS:  # go on with the units of these texts
            self.known = {unit: self.known[unit] for unit in set(chain.from_iterable(units))}
            self.spaced = {word: self.spaced[word] for word in set(chain.from_iterable(words))}
        return out

    def _learn(self, names: list[str], known: dict[str, bytes], lead: str = "") -> None:
        """Encode new units, each one ``lead`` and a name: in strings of JOINED ones where no token can reach from one into the next, which cost less than as many calls."""
        strung = names if lead else [u for u in names if u[:1] in _JOINT and not u[-1:].isspace()]
        apart = [] if lead else list(set(names).difference(strung))
        rows = [strung[at:at + JOINED] for at in range(0, len(strung), JOINED)]
        for at in range(0, len(rows), 16):
            part = rows[at:at + 16]
            texts = [lead + lead.join(row) for row in part]
            for row, text, coded in zip(part, texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(coded.ids, dtype="<u4")
                ends = np.cumsum(self.sizes[ids])
                sizes = map(len, row if text.isascii() else map(str.encode, row))
                of = np.cumsum(np.fromiter(sizes, np.int64, len(row)) + len(lead))  # where each unit ends, in bytes
                cut = np.searchsorted(ends, of)
                if not len(ends) or cut[-1] >= len(ends) or (ends[cut] != of).any():
                    apart += row  # not a byte-level vocabulary
                    continue
                data, start = ids.tobytes(), 0
                for name, end in zip(row, ((cut + 1) * 4).tolist()):
                    known[name] = data[start:end]
                    start = end
        for at in range(0, len(apart), 1000):
            part = apart[at:at + 1000]
            for name, coded in zip(part, self.tokenizer.encode_batch_fast([lead + name for name in part], add_special_tokens=False)):
                known[name] = array("I", coded.ids).tobytes()


def unit_encoder(definition: str) -> UnitEncoder:
    """One encoder for each Python worker, while it packs."""
    return kept(PACKING, definition, UnitEncoder)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of each piece. ``tokenizer``: path of a tokenizer file that the driver reads."""
    definition = Path(tokenizer or default_tokenizer()).read_text()
    rows = id_text(df, id_col, text_col)
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def make():
        encoder = unit_encoder(definition)

        def apply(c):
            out: dict[str, list] = {n: [] for n in names}
            for key, ids in zip(c["id"], encoder.encode(c["text"])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start:first if not piece else start + capacity]
                    row = (key, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32))
                    for name, value in zip(names, row):
                        out[name].append(value)
            return out
        return apply

    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return map_batches(rows, make, schema + (", ids array<int>" if keep_ids else ""), PACKING)


def grouped(counts: np.ndarray, groups: int, above: int) -> list[tuple[int, dict[int, int]]]:
    """(size, {length: count}) of equal-cardinality groups of the lengths ``above`` a bound, longest first."""
    lengths = [n for n in range(len(counts) - 1, above, -1) if counts[n]]
    per_group = max(1, -(-int(counts[above + 1:].sum()) // groups))
    out: list[tuple[int, dict[int, int]]] = []
    room = 0
    for length in lengths:
        todo = int(counts[length])
        while todo:
            if not room:
                out.append((length, {}))
                room = per_group
            take = min(room, todo)
            out[-1][1][length] = take
            room, todo = room - take, todo - take
    return out


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The combination of sizes of the greatest value that fits: an unbounded knapsack over capacities."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in np.flatnonzero(values > 1e-9):
        size = int(sizes[k])
        for _ in range(capacity // size):  # one copy more each time
            reach = best[:-size] + values[k]
            better = np.flatnonzero(reach > best[size:] + 1e-12)
            if not len(better):
                break
            best[better + size] = reach[better]
            choice[better + size] = k
    pattern, room = np.zeros(len(sizes)), capacity
    while room >= 0 and choice[room] >= 0:
        pattern[choice[room]] += 1
        room -= int(sizes[choice[room]])
    return float(pattern @ values), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int = MAX_COLUMNS) -> list[tuple[np.ndarray, float]]:
    """(pattern, how many sequences) that cover ``demand``: column generation with a revised simplex.

    Stops when the dual bound is within half a sequence or a thousandth; every state is a covering, so the bound on
    columns limits time, not correctness.
    """
    n = len(sizes)
    columns = np.diag(np.floor(capacity / sizes))
    cost, inverse = np.ones(n), np.diag(1 / np.floor(capacity / sizes))
    amount = inverse @ demand
    for _ in range(max_columns):
        dual = cost @ inverse
        total = float(cost @ amount)
        spare = int(dual.argmin())
        if dual[spare] < -1e-9:  # making more of a size than asked for
            entering, price = -np.eye(n)[spare], 0.0
        else:
            value, entering = best_pattern(np.maximum(dual, 0), sizes, capacity)
            price = 1.0
            if value <= 1 + 1e-9 or total - total / value < max(0.5, total * 1e-3):
                break
        step = inverse @ entering
        able = np.flatnonzero(step > 1e-9)
        if not len(able):
            break
        leaving = int(able[(amount[able] / step[able]).argmin()])
        inverse[leaving] /= step[leaving]
        amount[leaving] /= step[leaving]
        others = np.arange(n) != leaving
        inverse[others] -= np.outer(step[others], inverse[leaving])
        amount[others] -= step[others] * amount[leaving]
        columns[:, leaving], cost[leaving] = entering, price
    return [(columns[:, k], float(amount[k])) for k in range(n) if cost[k] and amount[k] > 1e-9]


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> np.ndarray:
    """Rows (length, first rank, number of ranks, first sequence, offset) that place all pieces.

    ``counts[n]``: pieces of length n, up to ``capacity``. The plan's size depends on the lengths there are, not on
    how many pieces have them.
    """
    left = counts.astype(np.int64).copy()
    bins: list[tuple[int, tuple[int, ...]]] = []  # how many sequences hold these lengths
    large = grouped(left[:capacity], groups, capacity // small)  # a full piece fills a sequence
    if large:
        sizes, demand = np.array([s for s, _ in large]), np.array([float(sum(h.values())) for _, h in large])
        queues = [[[n, h[n]] for n in sorted(h, reverse=True)] for _, h in large]
        for pattern, amount in configurations(sizes, demand, capacity):
            runs: list[tuple[int, tuple[int, ...]]] = [(int(amount + 1e-6), ())]
            for k in np.flatnonzero(pattern > 0):
                for _ in range(int(pattern[k])):
                    runs = _substitute(runs, queues[k], left)
            bins += [r for r in runs if r[0] and r[1]]
    by_room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    waiting = np.zeros(capacity + 1, dtype=bool)

    def put(count: int, items: tuple[int, ...]) -> None:
        if count:
            room = capacity - sum(items)
            by_room[room].append((count, items))
            waiting[room] = True

    for count, items in bins:
        put(count, items)
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            rooms = np.flatnonzero(waiting[length:])
            room = length + int(rooms[0]) if len(rooms) else capacity
            each = room // length
            if len(rooms):
                count, items = by_room[room].pop()
                waiting[room] = bool(by_room[room])
            else:
                count, items = -(-todo // each), ()
            full = min(count, todo // each)
            put(full, items + (length,) * each)
            todo -= full * each
            if full < count and todo:
                rest = min(todo, each)
                put(1, items + (length,) * rest)
                todo, full = todo - rest, full + 1
            put(count - full, items)
    rows, ranks, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for stack in by_room:
        for count, items in stack:
            at = 0
            for length in items:
                rows.append((length, ranks[length], count, sequence, at))
                ranks[length] += count
                at += length
            sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _substitute(runs: list, queue: list, left: np.ndarray) -> list:
    """Give every sequence of ``runs`` the next actual length of a group; what the queue can't fill stays without."""
    out = []
    for count, items in runs:
        while count and queue:
            take = min(count, queue[0][1])
            out.append((take, items + (queue[0][0],)))
            left[queue[0][0]] -= take
            queue[0][1] -= take
            count -= take
            if not queue[0][1]:
                queue.pop(0)
        if count:
            out.append((count, items))
    return out


def place(parts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """``parts`` (id, piece, length, ids_crc32, ...) with ``sequence_id`` and ``offset`` for each row."""
    histogram = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    table = plan(counts, capacity, groups, small)
    keys = table[:, 0] << 44 | table[:, 1]  # by length, then first rank

    salts = max(1, -(-int(counts.max(initial=0)) // RANK_ROWS))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("id", "piece", "start"), F.lit(salts)).cast("int"))
    before = (salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
              .drop("_n"))
    order = Window.partitionBy("length", "_salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(order) - 1)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def look_up(length, rank):
        import pandas as pd

        at = np.searchsorted(keys, length.to_numpy() << 44 | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + rank.to_numpy() - table[at, 1], "offset": table[at, 4]})

    return ranked.withColumn("_place", look_up("length", F.col("_rank").cast("long"))).select(
        *parts.columns, "_place.sequence_id", "_place.offset")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = CAPACITY, keep_ids: bool = False, **scheme) -> DataFrame:
    """(id, piece, start, length, ids_crc32, [ids,] sequence_id, offset) of every piece of every row."""
    return place(stored(pieces(df, id_col, text_col, tokenizer, capacity, keep_ids=keep_ids), "pieces"), capacity, **scheme)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces packed with ``keep_ids``; a sequence has at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
