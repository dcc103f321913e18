"""Texts with single spaces and line feeds are looked up word by word, without the spaces."""

from __future__ import annotations

from pathlib import Path

from scorelens.llm import packing


def test_units_of_single_spaces_are_known_without_them():
    encoder = packing.UnitEncoder(Path(packing.default_tokenizer()).read_text())
    texts = ["Plain words, plain\nlines and plain words.", "two  spaces and\n\nfeeds ", "a\ttab é 日本 plain", "\n", "", " lead", "é ç x\ny"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"plain", "\nlines", "words."} <= encoder.spaced.keys()
    assert " plain" not in encoder.spaced
