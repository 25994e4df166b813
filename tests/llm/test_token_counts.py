import functools
import os
import random

import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from ticketlens.llm.token_counts import Vocabulary, _apart, cut, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: What a cut may fall into: contractions, runs of blanks, digits, marks,
#: added tokens whole and broken, letters of several scripts.
PARTS = ["don't", "we'll", "'re", "'", "''ll", " ", "   ", "\n\n", "\t \n ", "word", "Wörter", "日本語の", "é", "12345", "½", "...",
         "<|endoftext|>", "<|endof", "text|>", "<|", "|>", " <|endoftext|> ", "a", "I", " ", "😀👍🏽", "́", "\x00"]


def _random(seed, n):
    rnd = random.Random(seed)
    return "".join(rnd.choice(PARTS) for _ in range(n))


@functools.lru_cache(maxsize=1)
def _library():
    return tokenizers.Tokenizer.from_file(BYTES)


def _whole(text):
    return len(_library().encode(text or "", add_special_tokens=False).ids)


def _counts(frame, path, **limits):
    got = token_counts(frame, Vocabulary.read(path), ["doc_id"], **limits)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    return {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got.collect()}


@pytest.mark.parametrize("step,overlap", [(64, 24), (200, 60), (33, 4)])
def test_chunks_count_like_whole_texts(spark, step, overlap):
    texts = [_random(i, n) for i, n in enumerate([1, 5, 30, 80, 200, 400, 400, 400, 900])]
    texts += ["x" * 3000, " " * 2000 + "a", "ab " * 700, "<|endoftext|>" * 150, "", None, texts[5], "'" * 500 + "ll"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = _counts(frame, BYTES, step=step, overlap=overlap)
    assert got == {i: (len((t or "").encode()), _whole(t)) for i, t in enumerate(texts)}


def test_overlaps_widen_until_they_align(spark):
    """One word longer than several widened chunks, between ordinary words."""
    text = "some words and " * 40 + "ab" * 4000 + " then more words" * 40
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert _counts(frame, BYTES, step=100, overlap=30)[1] == (len(text), _whole(text))


def test_huge_text_with_default_limits(spark):
    text = " ".join(_random(i, 40) for i in range(2000))
    assert len(text) > 5 * (1 << 15)
    frame = spark.createDataFrame([(1, text), (2, text), (None, text[:40_000])], "doc_id long, text string")
    assert _counts(frame, BYTES) == {1: (len(text.encode()), _whole(text)), 2: (len(text.encode()), _whole(text)),
                                     None: (len(text[:40_000].encode()), _whole(text[:40_000]))}


def test_other_tokenizers_encode_whole_texts(spark):
    import sentencepiece
    texts = [_random(3, 300).replace("\x00", ""), "Plain words. " * 9, "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = tokenizers.Tokenizer.from_file(WORDS)
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    limits = {"step": 50, "overlap": 10}
    assert {k: v[1] for k, v in _counts(frame, WORDS, **limits).items()} == {
        i: len(words.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {k: v[1] for k, v in _counts(frame, PIECES, **limits).items()} == {
        i: len(pieces.encode(t or "")) for i, t in enumerate(texts)}
    assert Vocabulary.read(BYTES).splits and not Vocabulary.read(WORDS).splits and not Vocabulary.read(PIECES).splits


def test_added_tokens_that_may_overlap_are_not_split():
    assert _apart(["<|a|>", "<|b|>"]) and not _apart(["aba"]) and not _apart(["abc", "b"]) and not _apart(["xab", "aby"])


def test_chunks_cover_the_text():
    for n in (0, 1, 9, 10, 14, 15, 16, 47):
        text = "".join(chr(65 + i % 26) for i in range(n))
        chunks = cut(text, 10, 4)
        assert "".join(c[:10] if i + 1 < len(chunks) else c for i, c in enumerate(chunks)) == text
        assert all(len(c) == 14 for c in chunks[:-1])


def test_query_columns_nulls_repeats_and_an_empty_table(spark, tmp_path):
    from ticketlens.llm.queries import QUERIES
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, "tok " * 600), (5, "tok " * 60_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("name", F.lit(1))
    os.mkdir(tmp_path / "a")
    frame.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = QUERIES["op12_token_counts"](spark, str(tmp_path / "a")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        ((i, len((t or "").encode()), _whole(t), _whole(t) > 512) for i, t in rows), key=str)
    os.mkdir(tmp_path / "b")
    frame.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert QUERIES["op12_token_counts"](spark, str(tmp_path / "b")).collect() == []


def test_remembered_pieces_count_like_the_library():
    """Texts of every plain character, and of parts that split in odd ways."""
    vocabulary = Vocabulary.read(BYTES)
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]]
    rnd = random.Random(9)
    texts = ["".join(rnd.choices(plain, k=rnd.randint(0, 60))) for _ in range(1500)]
    odd = ["'s", "'S", "'ll", "'", " ", "  ", "\n", "\r\n", "\t", "a", "É", "1", "²", "¼", "!", "_", "-", "°", "ª", "ǀ", "<|", "<|endoftext|>"]
    texts += ["".join(rnd.choices(odd, k=rnd.randint(0, 25))) for _ in range(1500)]
    texts += plain + [a + b for a in odd for b in odd]
    split = [vocabulary.pieces(t) for t in texts]
    assert sum(p is not None for p in split) > 3000
    assert all("".join(p) == t for t, p in zip(texts, split) if p is not None)
    assert vocabulary.counts(texts) == [_whole(t) for t in texts]
    assert vocabulary.pieces("日本") is None and vocabulary.pieces("a\x85b") is None
