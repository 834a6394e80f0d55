"""The source audit against exact plain counting."""

import collections
import random
import re

import numpy as np
import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    docs, n, langs = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", re.findall("[a-zA-Z\x80-\U0010ffff]+", text or "")
        terms = [t.translate(LOWER) for t in terms]
        langs[lang].add(source)
        for t in set(terms):
            docs[lang, t] += 1
        for t in terms:
            n[lang, source, t] += 1
    out = set()
    for lang, sources in langs.items():
        kept = [t for (x, t), d in docs.items() if x == lang and d >= least]
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        whole = {t: sum(n[lang, s, t] for s in sources) for t in kept}
        all_ = sum(whole.values())
        p = {s: {t: 1 + 10**9 * (n[lang, s, t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (all_ + 5 * len(kept)) for t in kept}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if n[lang, s, t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(items)}
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefghé中" for b in "xyzÉ"] + ["A", "a"]
    out = [(" ".join(rnd.choices(words, [1 / (k + 1 + i % 7) for k in range(len(words))], k=rnd.randint(0, 30))), rnd.choice(["en", "en", "fr", None, ""]), f"s{i % 9}") for i in range(400)]
    out += [(None, "en", "none"), ("", "en", "none"), ("123 --", "xx", "only"), ("a" * 200_000 + "1b", "en", None), ("one", "de", "p"), ("two", "de", "q"), (None, None, None)]
    out += [("again again ax", "en", "s1")] * 40
    return out


@pytest.mark.parametrize("block, chunk, slab", [(64, 1024, 1024), (2, 3, 2), (1, 1, 1)])
def test_audit(spark, rows, monkeypatch, block, chunk, slab):
    from cantora.llm import divergence

    for name, x in (("BLOCK", block), ("CHUNK", chunk), ("SLAB", slab), ("HELD", 100)):
        monkeypatch.setattr(divergence, name, x)
    docs = spark.createDataFrame([(None, *r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n int, term string")
    got = divergence.audit(docs, 8, 5).collect()
    want = plain(rows, 8, 5)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {r.part for r in got} == {"pair", "term"} and any(r.value == 0 and r.lang == "de" for r in got)


def test_audit_of_nothing(spark):
    from cantora.llm.divergence import audit

    assert audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    from cantora.llm.divergence import share, shares

    rnd = random.Random(1)
    cases = [(n := rnd.randrange(10 ** rnd.randint(1, 15)), n + rnd.randrange(10 ** rnd.randint(1, 15)), rnd.randint(1, 10**7)) for _ in range(500)]
    want = [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in cases]
    assert [int(shares(np.array([n]), np.array([t]), v)[0]) for n, t, v in cases] == want
    df = spark.createDataFrame(list(enumerate(cases)), "i int, c struct<n:long,t:long,v:long>").coalesce(1)
    assert [r[1] for r in sorted(df.select("i", share(F.col("c.n"), F.col("c.t"), F.col("c.v"))).collect())] == want
