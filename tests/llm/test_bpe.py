"""Texts that leave their task against the library, with white space before pieces that are cut."""

import hashlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from strataloom.llm import bpe  # noqa: E402


def test_white_space_before_a_long_piece(spark):
    texts = [f"abc{gap}{'x' * 2000}{gap}end{gap}" for gap in ("\n\n", "\n", "  ", "\t\t\n", " \n ", " ")] + ["a" * 700 + "\n\n\n" * 300 + "b" * 700]
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spread=600).collect()}
    assert got == {i: hashlib.sha256(np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in enumerate(texts)}


def test_very_long_texts_at_the_default_spread(spark):
    """Over 1 MiB, with runs that are cut among every kind of white space, special strings and characters of several bytes."""
    filler = " tail words, ça va 漢字" * 45_000
    texts = ["foo bar\n\n" + "x" * 300_000 + filler, "a \t" + "ab" * 80_000 + "\r\n \n<|endoftext|>" + "é" * 90_000 + "  " + filler, filler + "\n\n\t" + "0" * 140_000 + "  ", "<|endoftext|>" + "-=" * 90_000 + "\n" + "Z" * 150_000 + "\n\n" + filler]
    assert all(len(t.encode()) > bpe.SPREAD for t in texts)
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i] == (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
