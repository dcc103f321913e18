"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives Viterbi.

The automaton reads a text once. At each character its output links name every piece that ends there;
each relaxes the best score at that position from the best score where the piece begins. Characters that
no piece covers cost a fixed penalty and are spelt as byte pieces. Ties go to the longest piece.

No piece of the vocabulary has a space after another character, so a best segmentation never joins what lies on both
sides of such a place: units cut there are segmented apart, and each distinct one once (a bounded
memory in each worker). A vocabulary with such pieces is segmented text by text.

The scores are taken as they are: with a unigram model this is the public segmentation; with a BPE model, whose scores are
merge ranks, it is the best sum of ranks, not BPE's merges, and the ids differ from that library's.

Defined results: null text counts as empty; an empty text has no pieces; the space mark U+2581 in a text reads as a
space, as in the public format, and does not come back as itself (``round_trip`` false); repeated rows
come back as given; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from scorelens.llm.common import id_text, map_batches

MARK, CACHED_UNITS, UNKNOWN_PENALTY = "▁", 300_000, 10.0
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Codec:
    """Pieces, scores and automaton of one model file's content."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.automaton, self.spelling, self.byte_ids, lowest = ahocorasick.Automaton(), [], {}, 0.0
        self.whole = False  # whether texts must be segmented as wholes
        for k in range(pieces.vocab_size()):
            text = pieces.id_to_piece(k)
            if pieces.is_byte(k):
                self.byte_ids[int(text[3:5], 16)] = k
                self.spelling.append(bytes([int(text[3:5], 16)]))
            elif pieces.is_control(k) or pieces.is_unknown(k) or pieces.is_unused(k):
                self.spelling.append(b"")
            else:
                self.automaton.add_word(text, (len(text), pieces.get_score(k), k))
                self.spelling.append(text.replace(MARK, " ").encode())
                self.whole |= MARK in text.lstrip(MARK)
                lowest = min(lowest, pieces.get_score(k))
        self.automaton.make_automaton()
        self.penalty = lowest - UNKNOWN_PENALTY
        self.alphabet = {text for text in self.automaton.keys() if len(text) == 1}
        self.known: dict[str, tuple[bytes, float, int, bytes]] = {}

    def segment(self, unit: str) -> tuple[bytes, float, int, bytes]:
        """(ids as 4-byte numbers, score, characters spelt as bytes, what the ids decode to) of one unit, in one pass."""
        ids, score, spelt = self._covered(unit) if self.alphabet.issuperset(unit) else self._spelt(unit)
        return array("I", ids).tobytes(), score, spelt, b"".join(map(self.spelling.__getitem__, ids))

    def _covered(self, unit: str) -> tuple[list[int], float, int]:
        """A unit whose every character is a piece: each position is reached, none is spelt."""
        best, start, piece = [0.0] + [-np.inf] * len(unit), [0] * (len(unit) + 1), [0] * (len(unit) + 1)
        for last, (length, score, k) in self.automaton.iter(unit):
            reach = best[last + 1 - length] + score
            if reach > best[last + 1]:
                best[last + 1], start[last + 1], piece[last + 1] = reach, last + 1 - length, k
        ids, at = [], len(unit)
        while at:
            ids.append(piece[at])
            at = start[at]
        return ids[::-1], best[-1], 0

    def _spelt(self, unit: str) -> tuple[list[int], float, int]:
        best, back = [0.0] + [-np.inf] * len(unit), [None] * (len(unit) + 1)
        done = 0  # positions up to here have their final score

        def fill(upto: int) -> None:
            nonlocal done
            while done < upto:
                spelt = best[done] + self.penalty  # a character of its own
                done += 1
                if done not in single and spelt > best[done]:
                    best[done], back[done] = spelt, (done - 1, -1)

        single: set[int] = set()  # ends of pieces of one character: these are never spelt
        for last, (length, score, piece) in self.automaton.iter(unit):
            end = last + 1
            fill(end - 1)
            if length == 1:
                single.add(end)
            reach = best[end - length] + score
            if reach > best[end]:
                best[end], back[end] = reach, (end - length, piece)
        fill(len(unit))
        ids, at, spelt = [], len(unit), 0
        while at:
            start, piece = back[at]
            if piece < 0:
                ids += [self.byte_ids[b] for b in reversed(unit[start:at].encode())]
                spelt += 1
            else:
                ids.append(piece)
            at = start
        return ids[::-1], best[-1], spelt

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float, int]]:
        """(ids, score, characters spelt) of each text."""
        return [coded[:3] for coded in self.encode_and_spell(texts)]

    def encode_and_spell(self, texts: list[str]) -> list[tuple[np.ndarray, float, int, bytes]]:
        """The same with what the ids decode to, unit by unit."""
        marked = [(MARK + t.replace(" ", MARK)) if t else "" for t in texts]
        units = [([t] if t else []) if self.whole else _UNITS.findall(t) for t in marked]
        for unit in set(chain.from_iterable(units)) - self.known.keys():
            self.known[unit] = self.segment(unit)
        out = []
        for own in units:
            ids, scores, spelt, spelling = zip(*map(self.known.__getitem__, own)) if own else ((), (), (), ())
            out.append((np.frombuffer(b"".join(ids), dtype="<u4"), sum(scores), sum(spelt), b"".join(spelling)))
        if len(self.known) > CACHED_UNITS:  # go on with the units of these texts
            self.known = {unit: self.known[unit] for unit in set(chain.from_iterable(units))}
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.read(b"".join(map(self.spelling.__getitem__, ids.tolist())))

    @staticmethod
    def read(spelling: bytes) -> str:
        """The text that joined spellings stand for."""
        return spelling.removeprefix(b" ").decode(errors="replace")


@lru_cache(maxsize=1)
def codec(model: bytes) -> Codec:
    """One codec for each Python worker."""
    return Codec(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, ids array<int>, score, n_spelt) for each row. ``model``: path of a model file that the driver reads."""
    return _encoded(df, id_col, text_col, model, keep_ids=True).select("id", "ids", "score", "n_spelt")


def encode_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, n_pieces, n_spelt, score, ids_crc32, round_trip) for each row: encodes, decodes again and compares."""
    return _encoded(df, id_col, text_col, model, keep_ids=False)


def _encoded(df: DataFrame, id_col: str, text_col: str, model: str | None, keep_ids: bool) -> DataFrame:
    content = Path(model or default_model()).read_bytes()
    rows = id_text(df, id_col, text_col)

    def make():
        own = codec(content)

        def apply(c):
            coded = own.encode_and_spell(c["text"])
            ids, scores, spelt, spelling = zip(*coded) if coded else ((), (), (), ())
            return {"id": c["id"], "n_pieces": list(map(len, ids)), "n_spelt": spelt, "score": list(map(float, scores)), "ids_crc32": [zlib.crc32(i.tobytes()) for i in ids],
                    "round_trip": [None if keep_ids else own.read(b) == t for b, t in zip(spelling, c["text"])],
                    "ids": [i.astype(np.int32) for i in ids] if keep_ids else None}
        return apply

    schema = (f"id {rows.schema['id'].dataType.simpleString()}, n_pieces long, n_spelt long, score double, ids_crc32 long, round_trip boolean")
    return map_batches(rows, make, schema + (", ids array<int>" if keep_ids else ""))


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id, text) for each row of (id, ids)."""
    from pyspark.sql import functions as F

    content = Path(model or default_model()).read_bytes()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")).alias("ids"))

    def make():
        own = codec(content)
        return lambda c: {"id": c["id"], "text": [own.decode(np.array(i, dtype=np.int64)) for i in c["ids"]]}

    return map_batches(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, text string")
