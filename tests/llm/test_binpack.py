"""Whole-document packing against plain encoding, plain search and its bounds."""

import collections
import random
import struct
import zlib

import numpy as np
import pytest

PATH_NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers as P

    return P.path(PATH_NAME)


def _plain(path, texts):
    from tokenizers import Tokenizer

    return [struct.pack(f"<{len(i)}I", *i) for i in (x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False))]


def test_encoder_gives_the_files_ids(path, monkeypatch):
    from cantora.llm import tokens
    from cantora.llm.shared import kept

    rnd = random.Random(3)
    marks = " \t\n\r\x1c\x1f\x85\xa0　ab1é.'s|中\U0001f642Ɏʰ́×-"
    texts = ["".join(rnd.choices(marks, k=rnd.randint(0, 50))) for _ in range(5000)]
    texts += ["", "It's they'd 'll can't", "a<|endoftext|>b <|endoftext|>", " " * 100_000 + "x", "word " * 30_000, "z" * 100_000]
    kept.clear()
    monkeypatch.setattr(tokens, "KEPT_PIECES", 500)
    encode = tokens.encoder(path)
    assert [b for lo in range(0, len(texts), 97) for b in encode(texts[lo : lo + 97])] == _plain(path, texts)


def test_encoder_of_another_file(tmp_path, path):
    import json

    from cantora.llm import tokens
    from cantora.llm.shared import kept

    setup = json.load(open(path))
    setup["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(setup))
    kept.clear()
    texts = ["word of words", " x", "", "a.b  c"]
    assert tokens.encoder(str(other))(texts) == _plain(str(other), texts) and not kept["apart"]


def _least(sizes, room):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= sizes[i] and bins[j] not in bins[:j]:
                bins[j] -= sizes[i]
                go(i + 1, bins)
                bins[j] += sizes[i]
        go(i + 1, [*bins, room - sizes[i]])

    go(0, [])
    return best[0]


def test_search_is_near_the_least_number_of_bins():
    from cantora.llm.binpack import best_fit, complete, least_bins

    rnd, over, better = random.Random(2), 0, 0
    for _ in range(400):
        room = rnd.choice([20, 37, 50, 100])
        sizes = sorted((rnd.randint(1, room) if rnd.random() < 0.3 else rnd.randint(max(1, room // 5), room // 2) for _ in range(rnd.randint(0, 11))), reverse=True)
        got, want, count = complete(np.array(sizes, np.int64), room), _least(sizes, room), np.bincount(np.array(sizes, np.int64), minlength=room + 1)
        assert sorted((x for b in got for x in b), reverse=True) == sizes and all(sum(b) <= room for b in got)
        assert least_bins(count) <= want <= len(got) <= len(best_fit(count))
        over, better = over + (len(got) > want), better + (len(best_fit(count)) > len(got))
    assert over <= 4 and better >= 5


def test_search_beats_best_fit_on_triplets():
    from cantora.llm.binpack import best_fit, complete

    rng = np.random.default_rng(4)
    sizes = rng.integers(560, 810, 600)
    assert len(complete(sizes, 2048)) < len(best_fit(np.bincount(sizes, minlength=2049)))


def test_dominance():
    from cantora.llm.binpack import dominates, fillings

    assert dominates((5,), (3, 2)) and dominates((5, 3), (4, 3)) and not dominates((4, 3), (5,)) and not dominates((3, 3), (4,))
    count = [0] * 11
    count[3], count[4], count[6] = 2, 1, 1
    assert fillings(count, 1 << 3 | 1 << 4 | 1 << 6, 7, 7) == [(4, 3), (6,)]  # (3, 3) fits into (4, 3)


def test_best_fit_pack(spark, path, monkeypatch):
    from cantora.llm import binpack

    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randint(0, 999)}" for _ in range(rnd.choice([0, 3, 40, 300, 700, 2500])))) for i in range(300)]
    rows += [(900, None), (900, ""), (None, "null id"), (901, "same"), (901, "same"), (902, "x" * 300_000), (903, " a" * 2047), (904, " a" * 2048)]
    docs = spark.createDataFrame([(*r, 7, "row") for r in rows], "doc_id long, text string, row int, sequence_id string")
    monkeypatch.setattr(binpack, "GROUP", 60)
    got = binpack.best_fit_pack(docs, path).collect()
    ids = collections.Counter()
    for (doc, _), b in zip(rows, _plain(path, [t or "" for _, t in rows]), strict=True):
        b += struct.pack("<I", 0)
        n = len(b) // 4
        first = n if n <= 2048 else n % 2048 or 2048
        at, k = 0, 0
        while at < n:
            size = first if not k else 2048
            ids[doc, k, at, size, zlib.crc32(b[4 * at : 4 * (at + size)])] += 1
            at, k = at + size, k + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ids
    assert max(r.piece for r in got) > 10 and any(r.length == 2048 and r.piece == 0 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 2048
    short = np.bincount([r.length for r in got if r.length < 2048], minlength=2049)
    assert len(by) <= binpack.least_bins(short) + sum(r.length == 2048 for r in got) + 2 * round(short.sum() / 60)
    assert binpack.best_fit_pack(docs.limit(0), path).count() == 0
