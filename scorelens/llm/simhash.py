"""SimHash near-duplicates: pigeonhole blocks, then the Hamming distance of what shares a block.

``fingerprints`` reads whole texts once; everything after works on 8-byte fingerprints, each
distinct one once, so a group of copies that holds a third of all rows is one member of its
bucket. Links are found in bounded buckets (``pigeonhole``), where a search from member to
member emits a spanning forest instead of all pairs: no link between different fingerprints
is lost, and the output stays linear.

Defined results: null text counts as empty; a text without words has fingerprint zero;
repeated rows are rows like any other and come back as often as given; rows without an id
are fingerprinted and linked, but a component is named by its smallest non-null id (null if it
has none). An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import id_text, map_batches, stored
from scorelens.llm.graph import connected_components
from scorelens.llm.pigeonhole import buckets

SEED = 42
_BYTE_OF = np.arange(8, dtype=np.uint16) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint (signed) whose bits are set in over half of ``hashes`` (uint64)."""
    if not len(hashes):
        return 0
    seen = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE_OF).ravel(), minlength=2048)
    ones = (seen.reshape(8, 256) @ _BITS).ravel()  # whole numbers, exact in doubles
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    words = text.encode().lower().split()  # of bytes: A-Z only, and the six ASCII spaces only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return majority(np.array([digest(joined, SEED)], dtype=np.uint64))
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-shingle]]
    return majority(np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[shingle - 1:])], dtype=np.uint64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for each row."""
    rows = id_text(df, id_col, text_col)
    return map_batches(rows, lambda: lambda c: {"id": c["id"], "fp": [fingerprint(t, shingle) for t in c["text"]]},
                       f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def spanning_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket, found by searching from member to member."""
    left, out = np.ones(len(fps), dtype=bool), []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start], reached = False, [start]
        while reached:
            at = reached.pop()
            near = np.flatnonzero(left & (np.bitwise_count((fps ^ fps[at]).view(np.uint64)) <= distance))
            left[near] = False
            reached.extend(near.tolist())
            out.extend((int(fps[at]), int(fps[k])) for k in near)
    return out


def links(fps: DataFrame, distance: int = 3, limit: int = 2048) -> DataFrame:
    """Edges (a, b) over distinct fingerprints: same components as all pairs within ``distance`` bits."""
    def apply(c):
        found = [pair for nodes in c["nodes"] for pair in spanning_links(np.array(nodes, dtype=np.int64), distance)]
        return {"a": [a for a, _ in found], "b": [b for _, b in found]}

    return map_batches(buckets(fps.select(F.col("fp").alias("node"), "fp"), distance, limit), lambda: apply, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    distance: int = 3, limit: int = 2048) -> DataFrame:
    """(id, fp, component, root) for each row of ``df``; component is the smallest id reachable over links, root the
    smallest fingerprint: two components can have one id if rows share ids."""
    prints = stored(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    each = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct_fingerprints")
    groups = connected_components(links(each.select("fp"), distance, limit))
    rooted = (each.join(groups, each["fp"] == groups["node"], "left")
              .select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return prints.join(rooted.join(named, "root").select("fp", "component", "root"), "fp").select("id", "fp", "component", "root")
