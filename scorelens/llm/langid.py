"""Language identification with a string kernel.

The kernel of two texts is the number of letter n-grams (all lengths from 1 to 4: a blended spectrum)
present in both, over the geometric mean of how many each has; n-grams are hashed to ``2 ** HASH_BITS`` places. A few
texts a language serve as Nystroem landmarks: a text becomes its kernel values against them, whitened by the landmarks' own
kernel matrix. Kernel ridge regression, one target a language, is solved on these coordinates, so that
scoring a batch of texts is two matrix products: presence by landmarks, then by weights.

Bounds (fit only): LANDMARKS and TRAINING texts a language, taken in the order of a hash of the id from
the rows to learn from; the driver holds one presence bitmap of 4 KB each, so it needs room for
(LANDMARKS + TRAINING) bitmaps a language. All rows are scored, over their whole texts.

Defined results: null texts, texts without a letter, and all texts if there is nothing to learn from, are ``und``
with score 0; equal scores go to the first language by name; rows without an id are scored but not
learnt from; repeated rows come back as given; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelens.llm.common import map_batches

LONGEST, HASH_BITS, LANDMARKS, TRAINING, RIDGE, BATCH = 4, 15, 48, 400, 1e-2, 64
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def presence(text: str) -> np.ndarray | None:
    """Which hashed n-grams the lower-cased text has, runs of other characters read as one space; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter | np.concatenate([[True], letter[:-1]])
    codes = np.concatenate([[32], np.where(letter, codes, 32)[keep], [32]]).astype(np.uint32)
    found, grams = np.zeros(1 << HASH_BITS, dtype=bool), np.zeros(len(codes), dtype=np.uint32)
    for n in range(LONGEST):
        grams = grams[:len(codes) - n] * np.uint32(0x01000193) + codes[n:] + np.uint32(n)
        mixed = grams * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        found[(mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - HASH_BITS)] = True
    return found


class Model:
    """Landmark bitmaps and ridge weights."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.packed, self.weights = languages, np.packbits(landmarks, axis=1), weights

    def __getstate__(self):  # travels packed; unpacked once a worker
        return {"languages": self.languages, "packed": self.packed, "weights": self.weights}

    def kernel(self, found: np.ndarray) -> np.ndarray:
        if not hasattr(self, "columns"):
            marks = np.unpackbits(self.packed, axis=1).astype(np.float32)
            self.columns = np.ascontiguousarray((marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))).T)
        rows = found.astype(np.float32)
        return (rows @ self.columns) / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))

    def scores(self, found: np.ndarray) -> np.ndarray:
        return self.kernel(found) @ self.weights

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        for start in range(0, len(texts), BATCH):
            prints = [(k, p) for k in range(start, min(start + BATCH, len(texts))) if texts[k] and (p := presence(texts[k])) is not None]
            if prints:
                scores = self.scores(np.stack([p for _, p in prints]))
                for (k, _), row in zip(prints, scores):
                    best = int(row.argmax())
                    out[k] = self.languages[best], float(np.clip(row[best], 0, 1))
        return out


def solve(languages: list[str], rows: list[tuple[str, int, bytes]], landmarks: int, ridge: float) -> Model:
    """Ridge weights from (language, rank, packed bitmap) rows; ranks below ``landmarks`` are the landmarks."""
    empty = Model([], np.zeros((0, 1 << HASH_BITS), dtype=bool), np.zeros((0, 0)))
    if not rows:
        return empty
    rows = sorted(rows)
    bitmaps = np.stack([np.frombuffer(r[2], dtype=np.uint8) for r in rows])
    unpacked = lambda part: np.unpackbits(part, axis=1).astype(bool)
    model = Model(languages, unpacked(bitmaps[[r[1] < landmarks for r in rows]]), np.zeros((0, 0)))
    kernel = np.concatenate([model.kernel(unpacked(bitmaps[k:k + 128])) for k in range(0, len(rows), 128)]).astype(float)
    own = model.kernel(unpacked(model.packed)).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    points = kernel @ whiten
    target = np.array([[float(r[0] == name) for name in languages] for r in rows])
    share = target.mean(0)
    weight = target @ (1 / np.maximum(share, 1e-9)) / len(languages)  # languages count alike
    inner = points.T @ (points * weight[:, None])
    solved = np.linalg.solve(inner + ridge * np.eye(len(inner)), points.T @ (target * weight[:, None]))
    model.weights = (whiten @ solved).astype(np.float32)
    return model


def fit(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        landmarks: int = LANDMARKS, training: int = TRAINING, ridge: float = RIDGE) -> Model:
    """Learn from the text and non-null language of the rows where ``learn`` holds."""
    rows = (df.where(learn).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                                   F.col(f"`{lang_col}`").alias("lang")).dropna())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    bound = landmarks + training
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("double") / (1 << 20)
    share = F.lit(0.0)
    for lang, n in counts.items():  # somewhat more than needed, so that the window below is bounded
        share = F.when(F.col("lang") == lang, F.lit(1.5 * bound / n + 20 / n)).otherwise(share)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.where(part <= share).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < bound)

    def apply(c):
        prints = [(lang, rank, p) for lang, rank, text in zip(c["lang"], c["rank"], c["text"]) if (p := presence(text)) is not None]
        return {"lang": [x[0] for x in prints], "rank": [x[1] for x in prints], "bits": [np.packbits(x[2]).tobytes() for x in prints]}

    found = map_batches(chosen.select("lang", "rank", "text"), lambda: apply, "lang string, rank int, bits binary").collect()
    return solve(sorted({r["lang"] for r in found}), [(r["lang"], r["rank"], bytes(r["bits"])) for r in found], landmarks, ridge)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def apply(c):
        found = model.predict(c["text"])
        return {"id": c["id"], "lang_pred": [lang for lang, _ in found], "score": [s for _, s in found]}

    return map_batches(rows, lambda: apply, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
