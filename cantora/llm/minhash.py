"""Near-duplicates by DartMinHash signatures, banded joins and exact verification."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from . import bloom
from .arrays import U
from .shared import chunks, frozen, ids_of

#: Words of a shingle, least similarity, bands and coordinates of a band.
SHINGLE, ALIKE = 5, 0.8
BANDS, ROWS = 30, 5
#: Candidate edges whose signatures agree in fewer coordinates than this share are dropped before exact verification.
HOPEFUL = 0.45
#: A text whose signature agrees this far with a bucket's end is done there: all that is alike to it is hopeful with that end.
#: Inside a bucket, texts whose signatures agree in fewer coordinates than CLOSE are not taken for alike.
SETTLED, CLOSE = 0.85, 0.6
#: A bucket's texts are compared in pairs up to WHOLE; more are split by SPLITS choices of SPLIT_BY coordinates first.
WHOLE, SPLITS, SPLIT_BY = 2048, 40, 5
#: Documents, and shingles of these, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20


#: Ranks of the first region.
LOWEST = 0.5


@cache
def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative Poisson law, for drawing counts by inversion."""
    k = np.arange(1, int(mean + 12 * np.sqrt(mean) + 14))
    return np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(mean / k))]) - mean))


def darts(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, k: int, seed: int = 3):
    """DartMinHash: of each document the key of the earliest dart at each of k coordinates, as an n x k array.

    Each element owns the strip [0, weight) of a plane of weights and ranks. The plane is cut into regions between powers of
    two, and a hash of element and region says how many darts fall there (Poisson, one a unit of area) and where; darts
    above the weight miss. A dart's hash names its coordinate; the one of least rank is kept. Ranks are searched up to a
    bound that fills every coordinate of a document with good odds, and doubled for those it leaves open. Two documents
    agree at a coordinate with the odds of their weighted Jaccard similarity. weight is 1 or more.
    """
    out, open_ = np.zeros((n, k), np.uint64), np.bincount(doc, minlength=n) > 0
    total = np.bincount(doc, weights=weight, minlength=n)
    reach = k * (np.log(k) + 2) / np.maximum(total, 1)
    flat = out.reshape(-1)
    best = np.full(n * k, np.inf)
    done = np.zeros(n)  # ranks below are searched
    while open_.any():
        live = open_[doc]
        top = float(reach[open_].max())
        strip = 0
        while strip == 0 or live.any() and float(weight[live].max()) > 2 ** (strip - 1):
            left, wide = (0.0, 1.0) if strip == 0 else (2.0 ** (strip - 1), 2.0 ** (strip - 1))
            rank, level = 0.0, 0
            while rank < top:
                high = LOWEST if rank == 0 else rank * 2
                mine = np.flatnonzero(live & (weight > left) & (reach > rank)[doc] & (done <= rank)[doc])
                if len(mine):
                    salt = ((seed << 32) + (strip << 16) + level) * 0x9E3779B97F4A7C15 % 2**64
                    h = A.mix(key[mine] + U(salt))
                    count = np.searchsorted(_poisson_table(wide * (high - rank)), (h >> U(11)) * 2.0**-53, "right")
                    hit = np.repeat(np.arange(len(mine)), count)
                    nth = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
                    d = A.mix(h[hit] + (nth + 1).astype(np.uint64) * U(0xD6E8FEB86659FD93))
                    at = rank + (high - rank) * ((A.mix(d + U(2)) >> U(11)) * 2.0**-53)
                    owner = mine[hit]
                    if float(weight[mine].min()) < left + wide:
                        ok = left + wide * ((A.mix(d + U(1)) >> U(11)) * 2.0**-53) < weight[owner]
                        owner, at, d = owner[ok], at[ok], d[ok]
                    cell = doc[owner] * k + (((d >> U(32)) * U(k)) >> U(32)).astype(np.int64)
                    np.minimum.at(best, cell, at)
                    won = at == best[cell]
                    flat[cell[won]] = d[won]
                rank, level = high, level + 1
            strip += 1
        # regions are searched whole, so a document has seen all ranks up to the power of two at its reach
        done = np.where(open_, LOWEST * 2.0 ** np.maximum(0, np.ceil(np.log2(np.maximum(reach, LOWEST) / LOWEST))), done)
        open_ &= np.isinf(best.reshape(n, k)).any(1) & (total > 0)
        reach = np.where(open_, done * 2, reach)
    return out


def _shingles(raw: np.ndarray, off: np.ndarray, words: int):
    """(text, shingle, times): the distinct shingles of each text, A-Z lower-cased; a shorter text is one shingle, an empty one has none."""
    low = A.LOWER[raw]
    starts, ends, first = A.words(low, off)
    sums = A.prefix(A.word_hashes(low, starts, ends))
    size = np.diff(first)
    n = np.where(size > 0, np.maximum(1, size - words + 1), 0)
    at = A.spread(first[:-1], n)
    doc = np.repeat(np.arange(len(size)), n)
    key = A.ranges(sums, at, np.minimum(at + words, first[1:][doc]))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    head = np.flatnonzero(A.firsts(doc, key))
    return doc[head], key[head], np.diff(np.append(head, len(doc)))


def _prints(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """A fingerprint of each text's shingle set; 0 if it has none."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, doc, A.mix(key + U(77)))
    return np.where(out == 0, U(0), A.mix(out + np.bincount(doc, minlength=n).astype(np.uint64)) | U(1)).view(np.int64)


def _node_key(node: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return A.mix(node.view(np.uint64) + A.mix(ids.astype(np.uint64)))


def signatures(docs: DataFrame, words: int = SHINGLE, weighted: bool = False) -> DataFrame:
    """doc_id, h (hash of the text), node (fingerprint of the shingle set, 0 for an empty text), size (shingles), bands (hashes of the signature's bands), sketch (a byte of each coordinate)."""
    k = BANDS * ROWS

    def run(batches):
        for batch, lo, hi, raw, off in chunks(batches, 1 << 20):
            n = hi - lo
            doc, key, times = _shingles(raw, off, words)
            node = _prints(doc, key, n)
            sig = darts(doc, key, times.astype(float) if weighted else np.ones(len(key)), n, k)
            band = np.zeros((n, BANDS), np.uint64)
            for r in range(ROWS):
                band = A.mix(band * U(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
            band = A.mix(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            sketch = (sig & U(255)).astype(np.uint8)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), batch.column("h").slice(lo, n), pa.array(node), pa.array(np.bincount(doc, minlength=n)), flat, pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "h", "node", "size", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, node long, size long, bands array<long>, sketch binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph (a, b): alternately each node's larger neighbours, then its smaller ones, move to the least of them, until nothing changes."""

    def least(e, low):
        m = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return e.join(m.withColumnRenamed("a", "c"), F.col("a") == F.col("c")).filter(F.col("b") < F.col("a") if low else F.col("b") > F.col("a"))

    e = frozen(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least(both, low=False).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        small = least(large, low=True)
        e = frozen(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a != b").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def bucket_edges(sketch: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows that join all rows of different labels whose sketches agree in CLOSE of their coordinates or more.

    Up to WHOLE rows, all pairs are compared. More rows are split by the values of SPLIT_BY coordinates, for SPLITS choices
    of these: rows alike at 0.8 are apart in all of them with odds of 1e-7. Rows that still are too many after three
    splits are compared in pairs. Rows of one label are not compared.
    """
    _, label = np.unique(label, return_inverse=True)
    up, out = np.arange(label.max() + 1), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def roots(at: np.ndarray) -> np.ndarray:
        nonlocal up
        while (up[up] != up).any():
            up = up[up]
        return up[label[at]]

    def meet(at: np.ndarray, depth: int) -> None:
        own = roots(at)
        if (own == own[0]).all():
            return
        if len(at) > WHOLE and depth < 3:
            rng = np.random.default_rng([len(at), depth])
            for _ in range(SPLITS):
                key = np.zeros(len(at), np.uint64)
                for c in rng.choice(sketch.shape[1], SPLIT_BY, replace=False):
                    key = key << U(8) | sketch[at, c].astype(np.uint64)
                order = np.argsort(key, kind="stable")
                edge = np.append(np.flatnonzero(A.firsts(key[order])), len(at))
                for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                    if hi - lo > 1:
                        meet(at[order[lo:hi]], depth + 1)
            return
        for i in range(0, len(at), 256):
            for j in range(i, len(at), 256):
                x, y = at[i : i + 256], at[j : j + 256]
                rx, ry = roots(x), roots(y)
                if (rx[0] == rx).all() and (rx[0] == ry).all():
                    continue
                same = (sketch[x][:, None] == sketch[y][None]).sum(2) >= CLOSE * sketch.shape[1]
                for a, b in zip(*np.nonzero(same & (rx[:, None] != ry[None])), strict=True):
                    ta, tb = top(label[x[a]]), top(label[y[b]])
                    if ta != tb:
                        up[max(ta, tb)] = min(ta, tb)
                        out.append((int(x[a]), int(y[b])))

    if len(label):
        meet(np.arange(len(label)), 0)
    return out


def _links(one: list[np.ndarray], two: list[np.ndarray], alike: float) -> np.ndarray:
    """Which pairs of sorted sets, one of either list, have a Jaccard similarity of `alike` or more."""
    m, n = len(one), len(two)
    size = np.array([len(s) for s in (*one, *two)], np.float64)
    items = np.concatenate([*one, *two])
    owner = np.repeat(np.arange(m + n), size.astype(np.int64))
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    head = A.firsts(items)
    start = np.flatnonzero(head)
    # only shingles that both lists hold count
    both = np.minimum.reduceat(owner, start) < m if len(start) else np.zeros(0, bool)
    both &= (np.maximum.reduceat(owner, start) >= m) if len(start) else False
    rank = np.cumsum(both) - 1
    kind = np.cumsum(head) - 1
    shared = both[kind]
    owner, where = owner[shared], rank[kind[shared]]
    met = np.zeros((m, n), np.float32)
    step = max(256, (1 << 21) // max(1, m + n))
    edge = np.searchsorted(where, np.arange(0, int(both.sum()) + step, step))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        x = np.zeros((m + n, step), np.float32)
        x[owner[lo:hi], where[lo:hi] % step] = 1
        for r in range(0, m, 1024):
            met[r : r + 1024] += x[r : min(m, r + 1024)] @ x[m:].T
    link = np.zeros((m, n), bool)
    for r in range(0, m, 256):
        e = min(m, r + 256)
        link[r:e] = met[r:e] * (1 + alike) >= alike * (size[r:e, None] + size[None, m:]) - 1e-6
    return link


def _reach(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Components of a graph between rows and columns (which are the same nodes, if `same`): a label for each row and each column."""
    m, n = link.shape
    rows, cols, label = np.full(m, -1), np.full(n, -1), 0
    for first in range(m):
        if rows[first] >= 0:
            continue
        new = np.array([first])
        rows[first] = label
        if same:
            cols[first] = label
        while len(new):
            met = np.flatnonzero(link[new].any(0) & (cols < 0))
            cols[met] = label
            new = (link[:, met].any(1) if len(met) else np.zeros(m, bool)) & (rows < 0)
            if same:
                new[met] |= rows[met] < 0
            new = np.flatnonzero(new)
            rows[new] = label
        label += 1
    alone = cols < 0
    cols[alone] = label + np.arange(int(alone.sum()))
    return rows, cols


def near_duplicates(docs: DataFrame, words: int = SHINGLE, alike: float = ALIKE, weighted: bool = False, filter_bits: int = 1 << 27) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, class_size, n_links, kept.

    Texts are sets of shingles of `words` words (A-Z lower-cased; a shorter text is one shingle). Two texts are linked if
    the sets' Jaccard similarity is `alike` or more; a class is a connected component of links, named by its smallest
    doc_id. n_links counts links to texts with other shingle sets. kept: the row is its class's smallest doc_id.
    Signatures take each shingle with weight 1, or (weighted) with its count.

    Rows with one shingle set are one node from the start. Nodes that share a band's hash meet its least and greatest node;
    edges whose signatures look hopeless go. Where a bucket's other nodes are still in several components, those that are
    not SETTLED by an end meet each other (bucket_edges). The components are then compared exactly, in tasks of BLOCK nodes
    (or BLOCK_SHINGLES shingles) by as many, so no task holds a component of any size and no pairs are written out but a
    spanning forest; the signatures of one bucket's unsettled nodes are in one task.
    A null or empty text, and one of white space only, is a class of its own. Null ids sort first; repeated rows share a
    class and all show kept if they carry its id; other columns are ignored; an empty table gives no rows.
    """
    return _classes(docs, words, alike, weighted, filter_bits).select("doc_id", "class_id", "class_size", "n_links", "kept")


def _classes(docs: DataFrame, words: int = SHINGLE, alike: float = ALIKE, weighted: bool = False, filter_bits: int = 1 << 27) -> DataFrame:
    """near_duplicates' columns, with h (hash of the text) and best: whether the row has its class's least (doc_id, h)."""
    spark = docs.sparkSession
    signed = frozen(signatures(docs, words, weighted))
    filled = signed.filter("node != 0")
    nodes = filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = frozen(nodes)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    ends = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi")
    met = banded.withColumn("k", F.xxhash64("band")).join(ends.select(F.xxhash64("band").alias("k"), F.col("band").alias("own"), "lo", "hi"), "k").filter("band = own")
    raw = met.select(F.col("node").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sketch = nodes.select("node", "sketch")
    pairs = raw.join(sketch.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a").join(sketch.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b")

    def hopeful(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                like = (x == y).mean(1)
                yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(like)], names=["a", "b", "like"]).filter(pa.array(like >= HOPEFUL))

    edges = frozen(pairs.select("a", "b", "sa", "sb").mapInArrow(hopeful, "a long, b long, like double"))
    tree = components(edges.select("a", "b"))
    # nodes of a bucket that its ends leave in several components
    inner = frozen(met.filter("node != lo AND node != hi").select("node", "band", "lo", "hi").join(tree.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left").select("node", "band", "lo", "hi", F.coalesce("root", "node").alias("root")))
    mixed = inner.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 != r2").select(F.col("band").alias("own"))
    near = edges.filter(F.col("like") >= SETTLED)
    near = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = inner.join(mixed, F.col("band") == F.col("own"), "left_semi")
    for end in ("lo", "hi"):
        rest = rest.join(near, (F.col("node") == F.col("a")) & (F.col(end) == F.col("b")), "left_anti")
    rest = rest.select("band", "node", "root").join(sketch.withColumnRenamed("node", "c"), F.col("node") == F.col("c")).select("band", "node", "root", "sketch")

    def inside(table):
        node = table.column("node").to_numpy()
        told = bucket_edges(np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1), table.column("root").to_numpy())
        return pa.table({c: pa.array([int(node[e[k]]) for e in told], pa.int64()) for k, c in enumerate("ab")})

    more = frozen(rest.groupBy("band").applyInArrow(inside, "a long, b long"))
    if not more.isEmpty():
        tree = components(more.unionByName(tree.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    member = frozen(tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct()).join(nodes.select("node", "doc_id", "size"), "node"))
    # the shingle sets of the nodes' first rows: found in a second reading through a bounded filter
    keys = member.agg(F.count(F.lit(1))).first()[0]
    bits = bloom.bits_for(keys, 12, filter_bits)

    def fill(batches):
        held = [np.zeros(0, np.uint64)]
        for batch in batches:
            held.append(_node_key(batch.column("node").to_numpy(), ids_of(batch, 0, batch.num_rows)))
        got = list(bloom.segments(np.concatenate(held), bits))
        yield pa.record_batch([pa.array([s for s, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names=["seg", "bits"])

    sent = spark.sparkContext.broadcast(bloom.joined(member.select("node", "doc_id").coalesce(8).mapInArrow(fill, "seg int, bits binary").toLocalIterator(), bits))

    def read(batches):
        for batch, lo, hi, text, off in chunks(batches, 1 << 20):
            m = hi - lo
            doc, key, _ = _shingles(text, off, words)
            node, ids = _prints(doc, key, m), ids_of(batch, lo, hi)
            hit = np.flatnonzero((node != 0) & bloom.has(_node_key(node, ids), bits, sent.value))
            cut = np.searchsorted(doc, np.arange(m + 1))
            small = (key >> U(16)).astype(np.uint64)
            sets = [np.sort(small[cut[i] : cut[i + 1]]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for i in hit]
            yield pa.record_batch([pa.array(node[hit]), pa.array(sets, pa.binary())], names=["node", "shingles"])

    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    blocks = member.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = member.select("node", "root").join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    dealt = placed.withColumn("pair", F.explode(others)).select("node", "root", "block", "pair.i", "pair.j").join(sets, "node")

    def compare(table):
        one, two = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        own, m = own[order], int((block == one).sum())
        unpacked = []
        for k in order.tolist():
            s = table.column("shingles")[k].as_py()
            wide = np.zeros((len(s) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(s, np.uint8).reshape(-1, 6)
            unpacked.append(wide.reshape(-1).view("<u8"))
        if one == two:  # pairs inside a block
            link = _links(unpacked, unpacked, alike)
            np.fill_diagonal(link, False)
            label, links = _reach(link, True)[0], link.sum(1)
        else:
            link = _links(unpacked[:m], unpacked[m:], alike)
            label, links = np.concatenate(_reach(link, False)), np.concatenate([link.sum(1), link.sum(0)])
        _, first, back = np.unique(label, return_index=True, return_inverse=True)
        return pa.table({"node": pa.array(own), "to": pa.array(own[first[back]]), "links": pa.array(links.astype(np.int64))})

    told = frozen(dealt.groupBy("root", "i", "j").applyInArrow(compare, T.StructType([T.StructField(c, T.LongType()) for c in ("node", "to", "links")])))
    links = told.groupBy("node").agg(F.sum("links").alias("n_links"))
    joined = told.filter("node != to").select(F.col("node").alias("a"), F.col("to").alias("b"))
    whole_groups = blocks.filter("blocks > 1").isEmpty()
    roots = joined.select(F.col("a").alias("node"), F.col("b").alias("root")) if whole_groups else components(joined)
    named = links.join(roots, "node", "left").select("node", "n_links", F.coalesce("root", "node").alias("root"))
    whole = signed.select("doc_id", "h", "node").join(named.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").drop("own")
    whole = frozen(whole.select("doc_id", "h", F.when(F.col("node") == 0, None).otherwise(F.coalesce("root", "node")).alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    id_ = F.coalesce("doc_id", F.lit(-(2**63)))
    classes = whole.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(id_.alias("id"), F.col("h"))).alias("least"), F.count(F.lit(1)).alias("class_size")).filter("class_size > 1")
    out = whole.join(classes.select((F.col("root") + 0).alias("r"), F.col("least.id").alias("least"), F.col("least.h").alias("least_h"), "class_size"), F.col("root") == F.col("r"), "left")
    class_id = F.when(F.col("least").isNull(), F.col("doc_id")).when(F.col("least") != F.lit(-(2**63)), F.col("least"))
    best = F.col("least").isNull() | (F.col("least") == id_) & (F.col("least_h") == F.col("h"))
    return out.select("doc_id", "h", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), "n_links", F.col("doc_id").eqNullSafe(class_id).alias("kept"), best.alias("best"), F.col("least").isNotNull().alias("_classed"))


def dedup_rows(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one with the least doc_id (null ids first), then the least hash of its text; of rows equal in both one.

    Rows go by id and text, so a row whose id another text has too is judged by its own text. Null and empty texts are
    classes of their own and all stay; columns stay as they are; an empty table stays empty.
    """
    got = frozen(_classes(docs).filter("_classed").groupBy("doc_id", "h").agg(F.first("best").alias("best"), F.count(F.lit(1)).alias("times")))
    got = got.filter("NOT best OR times > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("best").alias("_best"))
    same = lambda k: docs["doc_id"].cast("long").eqNullSafe(k["_id"]) & (F.xxhash64(docs["text"]) == k["_h"])
    several = got.filter("_best")
    stay = docs.join(got, same(got), "left_anti")
    if several.isEmpty():
        return stay
    # rows that repeat the one that stays: one of each
    one = docs.join(several, same(several), "left_semi").select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_h"))
    return stay.unionByName(one.groupBy("_id", "_h").agg(F.first("_row").alias("_row")).select("_row.*"))
