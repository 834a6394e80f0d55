"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .shared import chunks

UNKNOWN = "und"
#: Hashed n-gram features; documents that training reads at most, over all languages.
FEATURES, MOST_TRAINED = 1 << 14, 6000


def _grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every run of 2 and 3 bytes within a text, A-Z lower-cased, white space, digits and ASCII marks as one sign."""
    plain = A.LOWER.copy()
    plain[[b for b in range(128) if not chr(b).isalpha()]] = 32
    sym = plain[raw].astype(np.uint32)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out = []
    for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if len(sym) < n:
            continue
        h = sum(sym[i : len(sym) - n + 1 + i] << np.uint32(8 * i) for i in range(n)).astype(np.uint32)
        h = (h * np.uint32(salt)) ^ np.uint32(n)
        h ^= h >> np.uint32(15)
        out.append((text[: len(h)], (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 14), text[: len(h)] == text[n - 1 :]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([t[k] for t, _, k in out]), np.concatenate([h[k] for _, h, k in out]).astype(np.int64)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of -1 and 1 for each of n languages: all splits for up to 5 languages, else random splits whose rows lie far apart."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if (k >> i) & 1 else -1 for k in range(1, 2 ** (n - 1))] for i in range(n)], np.int8)
    rng, best, width = np.random.default_rng(seed), None, max(15, int(np.ceil(10 * np.log2(n))))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        far = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        far -= 10 * n * int((np.abs(code.sum(0)) == n).sum())
        if best is None or far > best[0]:
            best = far, code
    return best[1]


class Model:
    """langs; code (languages x bits); weights (features x bits); trust of each bit."""

    def __init__(self, counts: list[tuple[str, int, np.ndarray, np.ndarray]]):
        """counts: of each trained document its language, fold (0 or 1), features and their counts."""
        self.langs = sorted({lang for lang, *_ in counts})
        self.code = codewords(len(self.langs))
        self.trust = np.ones(self.code.shape[1])
        self._fit([c for c in counts if c[1] == 0] or counts)
        losses = [(np.log1p(np.exp(-self.margins(f, c) * self.code[self.langs.index(lang)]))) for lang, fold, f, c in counts if fold == 1 and len(f)]
        if losses:  # a bit that decides well on the other fold counts more
            self.trust = 1 / (0.05 + np.mean(losses, 0))
            self.trust /= self.trust.mean()
        self._fit(counts)

    def _fit(self, counts) -> None:
        seen = np.full((len(self.langs), FEATURES), 0.0)
        for lang, _, f, c in counts:
            seen[self.langs.index(lang)][f] += np.log1p(c)
        seen = (seen + 0.5 * seen.mean(1, keepdims=True) + 1e-9) / (seen.sum(1, keepdims=True) * 1.5 + 1e-9 * FEATURES)
        self.weights = np.zeros((FEATURES, self.code.shape[1]), np.float32)
        for b in range(self.code.shape[1] if len(self.langs) > 1 else 0):
            self.weights[:, b] = np.log(seen[self.code[:, b] > 0].mean(0) / seen[self.code[:, b] < 0].mean(0))

    def margins(self, f: np.ndarray, c: np.ndarray) -> np.ndarray:
        v = np.log1p(c)
        return (v @ self.weights[f]) / np.sqrt(max(1.0, float(v.sum())))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of margins: the language with the least weighted logistic loss, its share among all (0 to 1), and the margin to the next."""
        losses = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)
        p = np.exp(-(losses - losses.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        two = np.sort(p, 1)[:, ::-1]
        return best, p[np.arange(len(p)), best], two[:, 0] - (two[:, 1] if p.shape[1] > 1 else 0)


def _counts(raw, off):
    text, gram = _grams(raw, off)
    keys, n = np.unique(text * FEATURES + gram, return_counts=True)
    return keys // FEATURES, keys % FEATURES, n


def train(docs: DataFrame, most: int = MOST_TRAINED) -> Model | None:
    """A model from the rows (doc_id, text, lang) of docs. Of each language about most / languages rows are read, drawn by a hash of their id and text; at most 2 * most rows reach the driver, as n-gram counts. None if no row has a language and text."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", "doc_id")
    have = {r["lang"]: r["count"] for r in docs.filter(F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    if not have:
        return None
    rate = F.create_map(*[F.lit(x) for lang, n in have.items() for x in (lang, min(1.0, most / len(have) / n))])
    h = F.xxhash64(F.lit(11).cast("long"), "text", "doc_id")
    drawn = rows.filter(F.shiftrightunsigned(h, 11) * F.lit(2.0**-53) < F.element_at(rate, F.col("lang"))).withColumn("fold", F.pmod(h, F.lit(2).cast("long")).cast("int")).limit(2 * most)

    def count(batches):
        for batch, lo, hi, raw, off in chunks(batches, 1 << 18):
            doc, f, n = _counts(raw, off)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            part = batch.slice(lo, hi - lo)
            blobs = [(f[a:b].astype("<u2").tobytes(), np.minimum(n[a:b], 65535).astype("<u2").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("fold"), pa.array([x for x, _ in blobs], pa.binary()), pa.array([x for _, x in blobs], pa.binary())], names=["lang", "fold", "f", "n"])

    got = drawn.mapInArrow(count, "lang string, fold int, f binary, n binary").collect()
    counts = [(r["lang"], r["fold"], np.frombuffer(r["f"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u2").astype(np.float64)) for r in sorted(got, key=lambda r: (r["lang"], r["f"], r["n"]))]
    return Model(counts) if counts else None


def _judge(m: Model | None, raw: np.ndarray, off: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text its language, score and whether another language is nearly as near."""
    n = len(letters)
    if m is None:
        return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    doc, f, c = _counts(raw, off)
    v = np.log1p(c)
    cut = np.searchsorted(doc, np.arange(n + 1))
    weighted = m.weights[f] * v[:, None]
    sums = np.zeros((len(v) + 1, weighted.shape[1]))
    np.cumsum(weighted, axis=0, out=sums[1:])
    mass = np.concatenate([[0.0], np.cumsum(v)])
    margins = (sums[cut[1:]] - sums[cut[:-1]]) / np.sqrt(np.maximum(1.0, mass[cut[1:]] - mass[cut[:-1]]))[:, None]
    best, score, gap = m.decode(margins)
    return [m.langs[b] if k else UNKNOWN for b, k in zip(best, letters, strict=True)], np.where(letters, score, 0.0), ~letters | (gap < 0.2)


def letters():
    """A column: whether `text` has a letter."""
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None, carry: list[str]) -> DataFrame:
    """carry's columns of docs with lang_pred, score (0 to 1) and ambiguous (another language is nearly as near)."""
    fields = docs.select(*carry).schema.fields
    shape = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # FEATURES x bits numbers

    def run(batches):
        for batch, lo, hi, raw, off in chunks(batches, 1 << 18):
            part = batch.slice(lo, hi - lo)
            langs, score, unsure = _judge(sent.value, raw, off, np.array(part.column("_letters").to_pylist(), bool))
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in carry), pa.array(langs, pa.string()), pa.array(score), pa.array(unsure)], names=[*carry, "lang_pred", "score", "ambiguous"])

    return docs.select(*carry, *([] if "text" in carry else ["text"]), letters().alias("_letters")).mapInArrow(run, shape)


def predicted(model: Model | None, spark):
    """A column: the language of `text`, or UNKNOWN. Only the text goes to Python; a row's other columns stay in the JVM."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StringType())
    def lang(cols: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, letters in cols:
            batch, out = pa.record_batch([text, letters], names=["text", "letters"]), []
            for _, lo, hi, raw, off in chunks([batch], 1 << 18):
                out += _judge(sent.value, raw, off, np.array(letters.slice(lo, hi - lo).to_pylist(), bool))[0]
            yield pa.array(out, pa.string())

    return lang(F.col("text"), letters())


def held_out(doc_id: str):
    """Whether crc32 of the id's decimal text leaves 1 modulo 3 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, most: int = MOST_TRAINED) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score, ambiguous.

    Learns from text and lang of rows that are not held out (a row with a null id is neither held out nor learnt from).
    A null text, or one without a letter, is `und` with score 0 and ambiguous; so is every row if nothing can be learnt.
    Repeated rows get equal predictions; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), held_out("doc_id").alias("held_out"))
    model = train(rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull()), most)
    return predict(rows, model, ["doc_id", "held_out"])
