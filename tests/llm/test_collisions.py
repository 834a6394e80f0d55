"""Inputs made to share weak hashes or names: results must still be those of plain versions."""

import random

import pytest

from . import brute


def _swapped(letters, a, b):
    """A Thue-Morse word of two letters, and the same with the letters swapped."""
    bits = [bin(i).count("1") & 1 for i in range(letters)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


@pytest.fixture(scope="module", params=[2048, 16])
def pair(request):
    return _swapped(request.param, "a", "b")


def test_words_of_swapped_letters(spark, pair):
    from cantora.llm.substring_dedup import substring_dedup

    same = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{same} {pair[0]}"), (2, f"{same} {pair[1]}"), (3, f"x {same} {pair[1]} y")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (n, gone, digest) for d, (n, gone, _, digest) in brute.repeats(rows, 20, "word").items()}


def test_unseen_word_is_not_known(spark, pair):
    import zlib

    from cantora.llm.lm import score_corpus

    train, held = (next(i for i in range(100) if (zlib.crc32(str(i).encode()) % 7 == 2) == h) for h in (False, True))
    rows = [(train, f"one two {pair[0]}"), (held, f"one two {pair[1]}")]
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {train: (4, 4), held: (4, 3)}


def test_shingles_of_swapped_letters(spark, pair):
    from cantora.llm.minhash import near_duplicates

    same = [f"w{i}" for i in range(6)]
    rows = [(1, " ".join([*same, pair[0], "p", "q", "r"])), (2, " ".join([*same, pair[1], "p", "q", "r"])), (3, " ".join([*same, pair[1], "p", "q", "r"]))]
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.classes(rows)


def test_two_texts_under_one_id(spark):
    from cantora.llm.suffix_dedup import suffix_dedup

    rnd = random.Random(6)
    text = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=100))
    rows, want = [], {}
    for i in range(120):
        a, b, n = text(), text(), 10 * i
        own = [None] * 2 if i % 3 == 0 else [n, n]
        rows += [(own[0], a), (own[1], b), (n + 1, a), (n + 2, b), (n + 3, a[:25] + b[25:50] + a[50:75] + b[75:])]
        want |= {n + 1: 100, n + 2: 100, n + 3: 0}
    got = {r.doc_id: r.n_removed for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id in want}
    assert got == want
