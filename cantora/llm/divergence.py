"""Source divergence audit: how far apart sources use a language's terms, by two-dimensional group-block tiling."""

from __future__ import annotations

import collections
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import frozen, give_back, partitions

#: Runs of letters A-Z and of characters beyond ASCII.
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: The lower-casing of A-Z alone.
LOWER = {65 + i: 97 + i for i in range(26)}
SCALE, ADDED = 10**9, 5
#: Sources of a block, terms of a chunk and chunks that one tile goes through, about.
BLOCK, CHUNK, SLAB = 64, 1024, 1024
#: Entries a task counts before it hands them on.
HELD = 3 << 17
#: Chunk of a block's header.
HEAD = -1


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): a term's occurrences in a group's documents, and how many of these have it.

    A group without terms is one row with a null term. Each task adds up what it reads before anything is shuffled.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])

    def count(batches):
        # of each group: term -> occurrences << 32 | documents
        held: dict[tuple, dict] = {}
        size = words = 0

        def rows():
            for (lang, source), terms in held.items():
                names, both = list(terms), np.fromiter(terms.values(), np.int64, len(terms))
                for lo in range(0, len(names), 1 << 16):
                    t, c = names[lo : lo + (1 << 16)], both[lo : lo + (1 << 16)]
                    yield pa.record_batch([pa.array([lang]).take(pa.array(np.zeros(len(t), np.int8))), pa.array([source]).take(pa.array(np.zeros(len(t), np.int8))), pa.array(t, pa.string()), pa.array(c >> 32), pa.array(c & 0xFFFFFFFF)], schema=schema)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                of = held.setdefault((lang, source), {None: 0})
                found = TERM.findall(text.translate(LOWER))
                before, get = len(of), of.get
                for t, n in collections.Counter(found).items():
                    of[t] = get(t, 0) + (n << 32) + 1
                size, words = size + len(of) - before, words + len(found)
                if size > HELD or words > 1 << 29:
                    size = words = 0
                    yield from rows()
        yield from rows()
        give_back()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    found = docs.select(*text).mapInArrow(count, "lang string, source string, term string, n long, n_docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)) in whole numbers of 64 bits: the quotient's nine digits come three at a time."""
    below, whole = total + terms * ADDED, lambda a, b: F.call_function("div", a, b)
    out, rest = whole(n + ADDED, below), (n + ADDED) % below
    for _ in range(3):
        out, rest = out * 1000 + whole(rest * 1000, below), (rest * 1000) % below
    return out + 1


def shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """share of arrays; total and n broadcast against each other."""
    below = total + ADDED * terms
    q, r = np.divmod(n + ADDED, below)
    for _ in range(3):
        d, r = np.divmod(r * 1000, below)
        q = q * 1000 + d
    return q + 1


def _dense(cells, places: np.ndarray, groups: int) -> np.ndarray:
    out = np.zeros((groups, len(places)), np.int64)
    if cells is not None:
        g, pos, n = cells
        out[g, np.searchsorted(places, pos)] = n
    return out


class _Tile:
    """One pair submatrix while its blocks' chunks come by: sums of abs(p - q) over the terms of a slab."""

    def __init__(self, key):
        self.key, self.heads, self.terms, self.sums, self.chunk, self.cells = key, {}, 0, None, HEAD, {}

    def head(self, block: int, sources: list[str], totals: np.ndarray, terms: int) -> None:
        self.heads[block], self.terms = (sources, totals), terms

    def add(self, chunk: int, block: int, cells) -> None:
        if chunk != self.chunk:
            self.settle()
            self.chunk = chunk
        self.cells[block] = cells

    def settle(self) -> None:
        """The last chunk's terms go into the sums; a term that neither block has adds the same everywhere, and is counted with all terms at once."""
        _, i, j, slab = self.key
        # a block that no source's hash fell to has no header
        totals = [self.heads.setdefault(b, ([], np.zeros(0, np.int64)))[1] for b in (i, j)]
        if self.sums is None:
            self.sums = np.zeros([len(t) for t in totals], np.int64)
            self.none = np.zeros_like(self.sums)
            if self.terms:
                a, b = (shares(np.zeros_like(t), t, self.terms) for t in totals)
                self.none = np.abs(a[:, None] - b[None, :])
                if slab == 0:
                    self.sums += self.none * self.terms
        if self.cells:
            places = np.unique(np.concatenate([c[1] for c in self.cells.values()]))
            a, b = (shares(_dense(self.cells.get(x), places, len(t)), t[:, None], self.terms) for x, t in zip((i, j), totals, strict=True))
            for k in range(len(a)):
                self.sums[k] += np.abs(a[k] - b).sum(1) - len(places) * self.none[k]
        self.cells = {}

    def rows(self):
        self.settle()
        lang, i, j, _ = self.key
        left, right = self.heads[i][0], self.heads[j][0]
        a, b = np.nonzero(~np.eye(len(left), dtype=bool)) if i == j else (x.reshape(-1) for x in np.indices(self.sums.shape))
        pairs = [(left, a, right, b)] if i == j else [(left, a, right, b), (right, b, left, a)]
        for of, x, other, y in pairs:
            cols = pa.array([lang] * len(a), pa.string()), pa.array([of[k] for k in x], pa.string()), pa.array([other[k] for k in y], pa.string()), pa.array(self.sums[a, b])
            yield pa.RecordBatch.from_arrays(list(cols), names=["lang", "source", "item", "value"])


def _tiles(batches):
    """Rows sorted by tile, then chunk, headers first."""
    tile = None
    for batch in batches:
        cols = {c: batch.column(c) for c in ("lang", "i", "j", "slab", "chunk", "block", "terms")}
        cells, heads = batch.column("cells"), batch.column("heads")
        for r in range(batch.num_rows):
            lang, i, j, slab, chunk, block, terms = (cols[c][r].as_py() for c in cols)
            if tile is None or tile.key != (lang, i, j, slab):
                if tile is not None:
                    yield from tile.rows()
                tile = _Tile((lang, i, j, slab))
            if chunk == HEAD:
                told = heads[r].as_py()
                tile.head(block, [h["source"] for h in told], np.array([h["total"] for h in told], np.int64), terms)
            else:
                own = cells[r].values
                tile.add(chunk, block, tuple(own.field(c).to_numpy() for c in ("g", "pos", "n")))
    if tile is not None:
        yield from tile.rows()
    give_back()


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and the terms it has more of than its language.

    A language keeps the terms that at least `least_docs` of its documents have. Part `pair`: each other source of the
    language, with the sum over kept terms of the difference between both sources' smoothed shares, in billionths. Part
    `term`: the first `top` kept terms whose share in the source is above the language's, with the difference.

    Counts are added up before they are shuffled, so a source that holds most documents is no larger than its vocabulary.
    Sources of a language form blocks, its terms chunks; the count vectors of a block and chunk are one packed row, which
    goes to every tile (block, block, slab of chunks) that needs it. A tile goes through its chunks one after another and
    holds two blocks of one chunk and its submatrix. Groups and counts are frozen in the shared folder, so a lost
    executor repeats only its own tiles.

    A null text, language or source is '' and meets other '' there; a text without terms, however long, still makes its
    group occur; repeated rows count as often as they come; doc_id and other columns are ignored; equal values rank by item
    in UTF-8 order; without a kept term all pairs have value 0; an empty table gives no rows.
    """
    n = partitions(docs.sparkSession)
    counts = frozen(term_counts(docs))
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("d")).filter(F.col("d") >= least_docs).drop("d")
    kept = frozen(kept)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    chunk = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / CHUNK)).cast("int")
    numbered = kept.join(langs, "lang").withColumn("chunk", chunk).withColumn("pos", F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1)
    used = frozen(counts.filter("n > 0").join(numbered, ["lang", "term"]))

    blocks = counts.filter("term is null").groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(blocks, "lang").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks").cast("long")).cast("int"))
    groups = frozen(groups.withColumn("g", F.row_number().over(W.partitionBy("lang", "block").orderBy("source")) - 1))

    cells = used.select("lang", "source", "term", "n", "lang_n", "chunk", "pos").join(groups, ["lang", "source"])
    per = ["lang", "blocks", "terms", "block"]
    packed = cells.groupBy(*per, "chunk").agg(F.collect_list(F.struct("g", "pos", "n")).alias("cells")).withColumn("slab", (F.col("chunk") / SLAB).cast("int"))
    heads = groups.groupBy(*per).agg(F.sort_array(F.collect_list(F.struct("g", "source", "total"))).alias("heads")).withColumn("chunk", F.lit(HEAD))
    last = F.greatest(F.lit(0), F.floor((F.ceil(F.col("terms") / CHUNK) - 1) / SLAB)).cast("int")
    heads = heads.withColumn("slab", F.explode(F.sequence(F.lit(0), last)))
    both = packed.unionByName(heads, allowMissingColumns=True).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).repartition(n, "lang", "i", "j", "slab").sortWithinPartitions("lang", "i", "j", "slab", "chunk", "block")
    found = both.select("lang", "i", "j", "slab", "chunk", "block", "terms", "cells", "heads").mapInArrow(_tiles, "lang string, source string, item string, value long")
    pairs = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    of = [F.col(c) for c in ("n", "total", "lang_n", "lang_total", "terms")]
    terms = cells.select("lang", "source", F.col("term").alias("item"), (share(of[0], of[1], of[4]) - share(of[2], of[3], of[4])).alias("value"), F.lit("term").alias("part")).filter("value > 0")
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(by)).select(*names).unionByName(terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).select(*names))
