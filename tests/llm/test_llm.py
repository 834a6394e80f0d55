"""Corpus operators against plain versions, on generated documents with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import os
import random
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, sha string, row int, part int, node long"


def made(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    shared = [" ".join(rng.choices(vocab, k=60)) for _ in range(3)]
    texts = []
    for _ in range(n):
        body = rng.choices(vocab, k=rng.randint(1, 150))
        if rng.random() < 0.5:
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(shared).split()
        texts.append(" ".join(body))
    for i in range(0, n, 6):
        words = texts[i].split()
        words[len(words) // 2] = "Changed"
        texts += [" ".join(words), texts[i].upper(), texts[i]]
    texts += [None, "", "  \t\n", "a", "...", "12 34", "x " * 3000, "la " * 40, " double  blanks \n", "é" * 400]
    return [(i * 3, t, ("en", "fr", None)[i % 3], ("s0", "s1", None, "s0")[i % 4], 1, "clash", 5, 6, 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, rows that repeat in full, and one id with two texts."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (None, None), (5, text), (5, text), (5, "other words here"), (6, text)]
    return spark.createDataFrame([(a, b, "en", "s", 1, "", 1, 1, 1) for a, b in rows], SHAPE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def test_substring_dedup(docs, rows):
    from cantora.llm.substring_dedup import substring_dedup

    want = brute.repeats([r[:2] for r in rows], 20, "word")
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    assert {d: (r.n_words, r.n_removed, len(r.spans), r.kept_sha256) for d, r in got.items()} == want
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got.values())


def test_suffix_dedup(docs, rows):
    from cantora.llm.suffix_dedup import suffix_dedup

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs).collect()}
    assert got == brute.repeats([r[:2] for r in rows], 100, "byte")


def test_repeats_odd_rows(odd, empty):
    from cantora.llm.substring_dedup import substring_dedup

    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(odd).collect())
    assert got == {(None, 80, 0): 1, (None, 0, 0): 1, (5, 80, 80): 2, (5, 3, 0): 1, (6, 80, 80): 1}
    assert substring_dedup(empty).count() == 0


def test_anchors_of_a_text_beyond_the_position_bits():
    from cantora.llm.repeats import Repeats

    far = (1 << 24) + 4000
    raw = np.random.default_rng(8).integers(0, 256, far + 1000, dtype=np.uint8)
    raw[far:] = raw[:1000]
    _, _, _, place, anchor, s1, s2 = Repeats("byte", 100, 25)._anchors(raw, np.array([0, len(raw)]))
    assert (s2 <= place).all() and (place - s1 <= 75).all()
    early, late = ({(int(a), int(p) - lo) for a, p in zip(anchor, place, strict=True) if lo + 100 <= p < lo + 900} for lo in (0, far))
    assert early == late and len(early) > 5


@pytest.mark.parametrize("length, start, options", [(100, 25, {"chunk_bytes": 1 << 12, "part_seeds": 16}), (100, 25, {"position_bits": 8}), (70, 20, {}), (64, 8, {"gram": 5, "chunk_bytes": 1 << 13}), (50, 50, {})])
def test_doubling_from_other_lengths(docs, rows, length, start, options):
    from cantora.llm.suffix_dedup import suffix_dedup

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs, length, start, **options).collect()}
    assert got == brute.repeats([r[:2] for r in rows], length, "byte")


def test_suffix_odd_rows(odd, empty):
    from cantora.llm.suffix_dedup import suffix_dedup

    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(odd).collect())
    n = len(" ".join(f"w{i}" for i in range(80)))
    assert got == {(None, n, 0, 0): 1, (None, 0, 0, 0): 1, (5, n, n, 1): 2, (5, 16, 0, 0): 1, (6, n, n, 1): 1}
    assert suffix_dedup(empty).count() == 0


def test_exact_dedup(docs, rows, odd, empty):
    from cantora.llm.exact_dedup import dedup_rows, exact_dedup

    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").encode().lower()].append(d)
    want = {d: (max(g), len(g), d == max(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for d in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs).collect()} == want
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, filter_bits=300).collect()} == want
    assert sorted(r.doc_id for r in dedup_rows(docs, filter_bits=300).collect()) == sorted(max(g) for g in groups.values())
    kept = dedup_rows(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup(odd).count() == 6 and dedup_rows(odd).count() == 3
    assert exact_dedup(empty).count() == 0 and dedup_rows(empty).count() == 0


def test_near_duplicates(docs, rows, odd, empty):
    from cantora.llm.minhash import dedup_rows, near_duplicates

    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    want = brute.classes([r[:2] for r in rows])
    assert {d: (r.class_id, r.class_size) for d, r in got.items()} == want
    assert all(r.kept == (r.class_id == d) for d, r in got.items())
    assert sorted(r.doc_id for r in dedup_rows(docs).collect()) == sorted({c for c, _ in want.values()})
    assert near_duplicates(odd).count() == 6 and near_duplicates(empty).count() == 0
    links = brute.links([r[:2] for r in rows])
    assert {d: r.n_links for d, r in got.items()} == links and max(links.values()) > 0


def test_near_dedup_rows_go_by_row(odd, empty):
    from cantora.llm.minhash import dedup_rows

    kept = dedup_rows(odd)
    assert kept.columns == odd.columns and dedup_rows(empty).count() == 0
    assert collections.Counter((r.doc_id, r.text and r.text[:5]) for r in kept.collect()) == {(None, None): 1, (None, "w0 w1"): 1, (5, "other"): 1}
    assert collections.Counter((r.doc_id, r.text and r.text[:5]) for r in dedup_rows(odd.filter("doc_id is not null")).collect()) == {(5, "w0 w1"): 1, (5, "other"): 1}


def test_near_duplicates_in_blocks(docs, rows, monkeypatch):
    from cantora.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 2)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {d: (r.class_id, r.class_size) for d, r in got.items()} == brute.classes([r[:2] for r in rows])
    assert {d: r.n_links for d, r in got.items()} == brute.links([r[:2] for r in rows])


@pytest.mark.parametrize("whole", [2048, 3])
def test_near_duplicates_inside_a_bucket(docs, rows, monkeypatch, whole):
    from cantora.llm import minhash

    plain = minhash.signatures
    monkeypatch.setattr(minhash, "signatures", lambda *a: plain(*a).withColumn("bands", F.array(F.lit(7).cast("long"))))
    monkeypatch.setattr(minhash, "WHOLE", whole)
    got = {r.doc_id: (r.class_id, r.class_size) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute.classes([r[:2] for r in rows])


def test_bucket_edges_find_a_pair_among_unlike_texts():
    from cantora.llm.minhash import bucket_edges

    rng = np.random.default_rng(4)
    passage, n = rng.integers(0, 256, 240, dtype=np.uint8), 6000
    sketch = np.where(rng.random((n, 240)) < 0.45, passage, rng.integers(0, 256, (n, 240), dtype=np.uint8))
    sketch[[100, 5000]] = np.where(rng.random((2, 240)) < 0.9, passage, rng.integers(0, 256, (2, 240), dtype=np.uint8))
    assert (100, 5000) in {tuple(sorted(e)) for e in bucket_edges(sketch, np.arange(n))}


def test_darts_estimate_weighted_jaccard():
    from cantora.llm.minhash import darts

    doc, key = np.repeat([0, 1], 100), np.concatenate([np.arange(100), np.arange(20, 120)]).astype(np.uint64) * np.uint64(7919)
    weight = np.concatenate([np.full(100, 3.0), np.full(100, 2.0)])
    a, b = darts(doc, key, weight, 2, 2000)
    assert abs((a == b).mean() - 160 / (60 + 240 + 40)) < 0.05


def test_packing(docs, rows, odd, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from cantora.llm.packing import differencing, pack

    path = P.path("byte_bpe_50k.json")
    tok, by, seqs = Tokenizer.from_file(path), collections.defaultdict(list), collections.defaultdict(list)
    for r in pack(docs, path).collect():
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for d, t, *_ in rows:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length])))
            at += r.length
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= 2048
    assert pack(odd, path).filter("start = 0").count() == 6 and pack(empty, path).count() == 0


def test_encoder_on_long_blanks_and_added_tokens():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from cantora.llm.packing import _encoder

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    texts = ["plain words", *(f"a {t} b{t}" for t in added), " " * 1_000_000 + "a", "x" + "\n" * 1_000_000 + "b", "\u2003 " * 40_000 + "c"]
    want = [struct.pack(f"<{len(i)}I", *i) for i in (tok.encode(t, add_special_tokens=False).ids for t in texts)]
    assert added and _encoder(path)(texts) == want


def test_language(spark, docs, odd, empty):
    from cantora.llm.langid import codewords, held_out, identify

    rng = random.Random(5)
    sounds = {"en": ["the", "ing", "sh", "wh", "er"], "fr": ["eau", "ou", "qu", "é", "ai"], "de": ["sch", "ung", "ei", "ß", "ich"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[k], k=3)) for _ in range(12)), k) for i, k in ((i, list(sounds)[i % 3]) for i in range(300))]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows if got[i].held_out) > 0.98 * sum(r.held_out for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 for d, r in got.items())
    said = {r.doc_id: r for r in identify(docs).collect()}
    assert all((said[r.doc_id].lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in docs.collect())
    assert identify(odd).count() == 6 and identify(empty).count() == 0
    far = codewords(12)
    assert min((far[i] != far[j]).sum() for i in range(12) for j in range(i)) >= 8


def test_scoring(docs, rows, odd, empty):
    from cantora.llm.lm import score_corpus

    tokens = {d: [*(t or "").encode().lower().split(), "</s>"] for d, t, *_ in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = collections.Counter(x for d, w in tokens.items() if not held[d] for x in w)
    n, v = sum(c.values()), len(c)
    for r in score_corpus(docs).collect():
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 and r.score < 0
    assert score_corpus(odd).count() == 6 and score_corpus(empty).count() == 0


def test_scoring_joins_rare_tokens(docs, rows):
    from cantora.llm.lm import score

    a = {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in score(docs, F.lit(True)).collect()}
    b = {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in score(docs, F.lit(True), most_head=10, chunk_bytes=4096).collect()}
    assert a == b


def test_scoring_follows_the_pair_model(spark):
    from cantora.llm.lm import score

    for n in (20, 200, 1000):
        rows = [(i, t) for i, t, *_ in made(n, n)]
        tokens = {d: [*(t or "").encode().lower().split(), b"</s>"] for d, t in rows}
        learnt = [w for d, w in tokens.items() if d % 2]
        one = collections.Counter(x for w in learnt for x in w)
        two = collections.Counter(x for w in learnt for x in zip([None, *w], w))
        one[None], total, kinds = len(learnt), sum(one.values()), len(one)
        share = sum(c - 1 for c in two.values()) / total
        off, size = 0.0, 0
        for r in score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 2 == 1, chunk_bytes=1 << 15).collect():
            w, want = tokens[r.doc_id], 0.0
            for h, x in zip([None, *w], w):
                alone = (one[x] + 1) / (total + kinds)
                want += math.log10(share * min(1, two[h, x] / one[h]) + (1 - share) * alone if one[h] else alone)
            off, size = off + abs(r.score - want), size + len(w)
        assert off < 0.06 * size


def test_log_frequency_filter_keeps_its_error_rate():
    from cantora.llm.lm import level, read_levels

    for size in (100, 10_000, 1_000_000):
        keys = np.sort(np.random.default_rng(size).integers(0, 2**54, 2 * size, dtype=np.uint64))
        n = np.where(np.arange(2 * size) % 2, np.arange(2 * size) % 9, 0)
        got, want = read_levels(keys, n), np.where(n > 0, level(np.maximum(n, 1)), 0)
        assert (got >= want).all() and (got > want).mean() < 0.03


def test_nearest(spark):
    from cantora.llm.ann import nearest

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24)) * rng.uniform(0.5, 2, (400, 1))
    x[50:90] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, [0.0] * 24), (440, [float("nan")] * 24), (460, [None] * 24), (None, x[0].tolist())]
    got = collections.defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21)) and all(i != q and abs(s - x[q] @ x[i]) < 1e-9 for _, i, s in found)
        best = [i for i in np.lexsort((np.arange(400), -(x @ x[q]).round(10))) if i != q][:20]
        hit += len({i for _, i, _ in found} & set(best))
    assert hit >= 0.9 * 400
    assert nearest(df.filter("vec_id < 5"), F.col("vec_id") == 0).count() == 4 and nearest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("norms, n", [("unit", 500), ("unit", 4000), ("lognormal", 4000), ("few long", 4000)])
def test_nearest_reaches_its_recall(spark, norms, n):
    from cantora.llm.ann import nearest

    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= {"unit": np.ones((n, 1)), "lognormal": rng.lognormal(0, 1, (n, 1)), "few long": np.where(np.arange(n)[:, None] < 40, 5.0, 1.0)}[norms]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(set)
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    want = {q: set([int(i) for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]) for q in range(0, n, 20)}
    assert sum(len(got[q] & w) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_mixing(docs, rows, odd, empty):
    from cantora.llm.mixing import mix, mixed_rows, targets

    size = {d: len(brute.WORD.findall((t or "").encode())) for d, t, *_ in rows}
    got = mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs.repartition(5)).collect()))
    src, taken, goal = {r[0]: r[3] for r in rows}, collections.Counter(), {}
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        taken[src[r.doc_id]] += r.taken
        goal[src[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in goal.items()) and abs(sum(goal.values()) - sum(size.values())) < 1e-6
    assert targets([10, 1000, 1000]) == [30.0, 1320.0, 660.0]
    assert mixed_rows(docs).columns == docs.columns and mix(odd).count() == 6 and mix(empty).count() == 0 and mixed_rows(empty).count() == 0


def test_mixing_against_a_plain_walk(docs, rows, monkeypatch):
    from cantora.llm import mixing

    monkeypatch.setattr(mixing, "UNIT", 7)
    keys = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(9).cast("long"), "doc_id", "text").alias("h")).collect()}
    size = {d: len(brute.WORD.findall((t or "").encode())) for d, t, *_ in rows}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sorted((r[0] for r in rows if r[3] == s), key=lambda d: (keys[d] % 2**64 >> 1, keys[d], d)) for s in names}
    total = {s: sum(size[d] for d in own[s]) for s in names}
    goal = dict(zip(names, mixing.targets([total[s] for s in names]), strict=True))
    ends = np.cumsum(mixing.shard_quotas(np.array([-(-round(goal[s]) // 7) for s in names]), 64, np.random.default_rng(9)), 0)
    want = {}
    for k, s in enumerate(names):
        passes, at = int(goal[s] // total[s]), 0
        quota = round(goal[s] - passes * total[s])
        for d in own[s]:
            part = max(0, min(size[d], quota - at))
            times = passes + (part > 0) if size[d] else 0
            want[d] = passes * size[d] + part, [int((ends[:, k] <= (at + j * total[s]) // 7).sum()) for j in range(times)]
            at += size[d]
    assert {r.doc_id: (r.taken, r.shards) for r in mixing.mix(docs).collect()} == want
    words = collections.Counter(r.text for r in mixing.mixed_rows(docs).collect())
    assert abs(sum(len(t.encode().split()) * n for t, n in words.items()) - sum(size.values())) < 1500


def test_shard_quotas():
    from cantora.llm.mixing import shard_quotas

    held = np.array([500, 0, 3, 77_000_000])
    got = shard_quotas(held, 64, np.random.default_rng(1))
    assert (got.sum(0) == held).all() and got.sum(1).max() - got.sum(1).min() <= 1 and (got >= 0).all()
    x = np.array([shard_quotas(np.array([30, 70]), 2, np.random.default_rng(k))[0, 0] for k in range(4000)])
    assert abs(x.mean() - 15) < 0.15 and abs(x.var() - 50 * 0.3 * 0.7 * 50 / 99) < 0.5


def test_sharding(docs, odd, empty):
    from cantora.llm.sharding import shard

    for df, most in ((docs, 4), (odd, 2), (docs, 1 << 16)):
        got = df.transform(lambda d, most=most: shard(d, 7, block_rows=most)).collect()
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[s]) for s in range(7)]
        assert len(got) == df.count() and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shard(empty).count() == 0
    plan = shard(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hypergeometric_law(spark):
    from cantora.llm.sharding import _draw

    x = spark.range(8000).selectExpr(_draw("1000L", "300L", "200L", "rand(5)") + " AS x").selectExpr("avg(x)", "variance(x)").first()
    assert abs(x[0] - 60) < 0.5 and abs(x[1] - 33.63) < 3


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, SHAPE).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "language_id":
            assert docs.count() == before.filter(F.col("text").rlike(r"\p{L}")).count()
        if name == "exact_dedup":
            assert docs.count() == before.select(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).distinct().count()
        if name == "near_dedup":
            assert {r.doc_id for r in docs.collect()} == {c for c, _ in brute.classes([(r.doc_id, r.text) for r in before.collect()]).values()}
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 0
    assert docs.count() > 0


def test_pipeline_runs_on_empty_and_odd_tables(spark, tmp_path, odd):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for k, rows in enumerate((odd.limit(0), odd)):
        rows.select(*names).write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / str(k)))
        assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and (got.count() > 0) == bool(k)
