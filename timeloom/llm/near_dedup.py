"""Operator 9, MinHash near-dedup by fast similarity sketching.

Every document's word shingles are fingerprinted and thrown into ``COORDINATES`` bins, round after round with new hashes,
until every bin is filled (Dahlgaard, Knudsen and Thorup 2017); each coordinate then agrees between two documents with a
probability of their Jaccard similarity, and the share that agrees is concentrated about it. Bands of coordinates
give candidates, and every link is verified on the full sets.

Copies of one set are one node from the start. Links are then found in two steps, neither of which makes all pairs of a bucket:

* Hubs. Every member of a bucket meets its smallest member by sketch; each document is verified against the most similar hub it has,
  and what is linked becomes one class. Where many rows are left, that is repeated with a second hub. A family of near copies is a class
  after it, at a cost in proportion to its members.
* Blocks. Buckets that hold several classes are dealt to blocks of bounded size in which members of different classes meet
  by sketch; the largest class of a bucket is not compared with itself. Documents with a close one of another class form
  families, whose blocks compare full sets in the same way and return a spanning forest of links.

What is left quadratic are documents of one bucket that are in different classes after the hubs, in tasks of bounded size.
Links that are missed are those without a common band, 1 in 8 million at the threshold, and those whose sketches
look less similar than ``MARGIN`` standard errors under the threshold, fewer still.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document with fewer words than a shingle is one shingle. Defined cases:
a document without words or text has an empty set and is linked with nothing; a null ``doc_id`` has a null component and is
kept; rows that repeat a ``doc_id`` with different texts are documents of their own, each with the class of its text; equal rows
share their fate; an empty table gives an empty table; texts of any length are read whole; further columns pass through
``drop_near_copies`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import Workspace, documents, map_batches

BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
WORDS, PERCENT = 5, 80
#: Standard errors of the sketch under the threshold from which on a pair is verified.
MARGIN = 6
#: Hubs that a bucket's members meet before blocks are made, the second one if more rows than ``GROUP_ROWS`` are left.
HUBS = 2
#: Documents and shingles in a block, about.
BLOCK_DOCS, BLOCK_SHINGLES = 384, 250_000
#: Rows of small buckets that go to one call, about; as many are left to blocks without a further hub.
GROUP_ROWS = 20_000
#: Documents up to which ids are broadcast to fetch their texts; beyond, texts are shuffled to them.
BROADCAST_IDS = 500_000
_KEPT_WORDS = 200_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_ROUND = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_HASHES = _WordHashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct fingerprints of a text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _M2 + h[i : i + len(out)])
    return np.unique(out)


def sketch(items: np.ndarray) -> np.ndarray:
    """``COORDINATES`` values of (round, hash): the first round that throws something into a bin fills it, with its smallest hash."""
    t, n, empty = COORDINATES, len(items), np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, empty, np.uint64)
    at = 0
    while at < t and (out == empty).any():
        rounds = min(t - at, max(1, 3 * t // n))
        h = mix(items[None, :] ^ _ROUND[at : at + rounds, None])
        packed = (np.arange(at, at + rounds, dtype=np.uint64)[:, None] << np.uint64(54)) | (h >> np.uint64(10))
        np.minimum.at(out, (h % np.uint64(t)).ravel().astype(np.int64), packed.ravel())
        at += rounds
    for k in np.flatnonzero(out == empty):  # rounds t to 2t - 1: all go to bin k
        out[k] = (np.uint64(t + k) << np.uint64(54)) | (mix(items ^ _ROUND[t + k]).min() >> np.uint64(10))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = mix(h * _M1 + coordinates.reshape(BANDS, ROWS)[:, i])
    return h.view(np.int64)


def close_from(percent: int) -> float:
    """The estimated similarity from which on a pair may be over the threshold."""
    p = percent / 100
    return p - MARGIN * (p * (1 - p) / COORDINATES) ** 0.5


_FEATURES = "doc_id long, nd_text long, n_shingles long, nd_set binary, nd_bands array<long>, nd_bytes binary"


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands, tails = [], [], [], []
            for text in batch["text"]:
                items = shingles(text.as_py(), width)
                n.append(len(items))
                if len(items):
                    c = sketch(items)
                    keys.append(xxhash.xxh3_128_digest(items.tobytes()))
                    bands.append(band_keys(c))
                    tails.append(mix(c).astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    bands.append(None)
                    tails.append(None)
            yield pa.record_batch(
                [batch["doc_id"], batch["nd_text"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                ["doc_id", "nd_text", "n_shingles", "nd_set", "nd_bands", "nd_bytes"],
            )

    return run


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity by the low bytes of the coordinates; one pair of bytes in 256 agrees by chance."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("nd_x", "nd_y"))
            est = _similarity((one == two).mean(axis=1))
        else:
            est = np.empty(0)
        yield pa.record_batch([batch["nd_id"], batch["nd_hub"], pa.array(est, pa.float64())], ["nd_id", "nd_hub", "nd_est"])


def _similarity(same: np.ndarray) -> np.ndarray:
    return (same - 1 / 256) / (1 - 1 / 256)


def nodes_of(features: DataFrame, w: Workspace) -> DataFrame:
    """A row per set: ``nd_id``, the document and text that stand for it (``nd_doc``, the smallest, and ``nd_text``), its bands and sketch."""
    sets = features.filter("nd_set is not null and doc_id is not null").groupBy("nd_set")
    first = F.min(F.struct(F.col("doc_id").alias("nd_doc"), "nd_text"))
    sets = w.write(sets.agg(first.alias("p"), F.first("nd_bands").alias("nd_bands"), F.first("nd_bytes").alias("nd_bytes")).select("nd_set", "p.*", "nd_bands", "nd_bytes"), "near-sets")
    # a doc_id that stands for several sets, its rows having different texts, names none of them
    several = w.write(sets.groupBy("nd_doc").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("nd_doc").alias("nd_several")), "near-several")
    if several.isEmpty():
        return sets.withColumn("nd_id", F.col("nd_doc"))
    nodes = sets.join(several, F.col("nd_doc") == F.col("nd_several"), "left")
    nodes = nodes.withColumn("nd_id", F.when(F.col("nd_several").isNull(), F.col("nd_doc")).otherwise(F.xxhash64("nd_set")))
    return w.write(nodes.drop("nd_several"), "near-nodes")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles(t.as_py(), width).view(np.int64) for t in batch["text"]]
            yield pa.record_batch([batch["nd_id"], pa.array(items, pa.list_(pa.int64()))], ["nd_id", "nd_items"])

    return run


class Search:
    """What the steps of one search for links share."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int, w: Workspace):
        self.docs, self.nodes, self.width, self.percent, self.w = docs, nodes, width, percent, w
        self.sketches = nodes.select("nd_id", "nd_bytes")
        self.close = close_from(percent)
        self.links: list[DataFrame] = []
        self.classes: DataFrame | None = None

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """(nd_id, nd_items) of the nodes in ``ids``. Of equal rows one is read."""
        wanted = self.w.write(self.nodes.select("nd_id", "nd_doc", "nd_text").join(ids.distinct(), "nd_id"), "near-wanted")
        small = wanted.count() <= BROADCAST_IDS
        texts = self.docs.select(F.col("doc_id").alias("nd_doc"), "nd_text", "text")
        texts = texts.join(F.broadcast(wanted) if small else wanted, ["nd_doc", "nd_text"]).select("nd_id", "text")
        return self.w.write(map_batches(texts, _sets(self.width), "nd_id long, nd_items array<long>").dropDuplicates(["nd_id"]), "near-items")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are linked, by their full sets."""
        sets = self.sets_of(pairs.select(F.col("a").alias("nd_id")).unionByName(pairs.select(F.col("b").alias("nd_id"))))
        one = sets.select(F.col("nd_id").alias("a"), F.col("nd_items").alias("nd_x"))
        two = sets.select(F.col("nd_id").alias("b"), F.col("nd_items").alias("nd_y"))
        both = pairs.join(one, "a").join(two, "b").withColumn("nd_both", F.size(F.array_intersect("nd_x", "nd_y")).cast("bigint"))
        union = F.size("nd_x") + F.size("nd_y") - F.col("nd_both")
        found = self.w.write(both.filter(100 * F.col("nd_both") >= self.percent * union).select("a", "b"), "near-links")
        self.w.free(sets)
        return found

    def add(self, links: DataFrame) -> None:
        if self.links and links.isEmpty():
            return
        self.links.append(links)
        every = self.links[0]
        for more in self.links[1:]:
            every = every.unionByName(more)
        self.classes = self.w.adopt(components(every))

    def with_class(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``nd_class``, the class of ``nd_id`` as far as it is known."""
        held = self.classes.select(F.col("id").alias("nd_id"), "component")
        return rows.join(held, "nd_id", "left").withColumn("nd_class", F.coalesce("component", "nd_id")).drop("component")

    def meet(self, members: DataFrame) -> DataFrame:
        """Every member (nd_id) meets its bucket's hub (nd_hub): (nd_id, nd_hub, nd_est), each pair once."""
        pairs = members.filter("nd_id <> nd_hub").select("nd_id", "nd_hub").distinct()
        both = pairs.join(self.sketches.withColumnRenamed("nd_bytes", "nd_x"), "nd_id")
        both = both.join(self.sketches.select(F.col("nd_id").alias("nd_hub"), F.col("nd_bytes").alias("nd_y")), "nd_hub")
        rated = map_batches(both, _estimate, "nd_id long, nd_hub long, nd_est double")
        return self.w.write(rated.filter(F.col("nd_est") >= self.close), "near-rated")

    def best(self, rated: DataFrame) -> DataFrame:
        """The most similar hub of each document."""
        best = F.max_by("nd_hub", F.struct("nd_est", -F.col("nd_hub")))
        return rated.groupBy("nd_id").agg(best.alias("b")).select(F.col("nd_id").alias("a"), "b")


def find_links(search: Search) -> DataFrame:
    """(id, component) of all documents with links."""
    w = search.w
    rows = search.nodes.select("nd_id", F.explode("nd_bands").alias("nd_band"))
    # joins of tables, not of aggregates, have a hot key's rows split at run time; so it is below
    hubs = w.write(rows.groupBy("nd_band").agg(F.count("*").alias("c"), F.min("nd_id").alias("nd_hub")).filter("c > 1").drop("c"), "near-hubs")
    members = w.write(rows.join(hubs, "nd_band"), "near-members")
    w.free(hubs)
    met = []
    for _ in range(HUBS):
        met.append(search.meet(members))
        search.add(search.verified(search.best(met[-1])))
        members = _mixed(search, members)
        left = members.count()
        if left <= GROUP_ROWS:
            break
    # who met a hub that may be linked with it, and is not in its class yet
    close = [search.with_class(m).join(search.classes.select(F.col("id").alias("nd_hub"), "component"), "nd_hub", "left") for m in met]
    close = [c.filter(F.col("nd_class") != F.coalesce("component", "nd_hub")).select(F.col("nd_id").alias("a"), F.col("nd_hub").alias("b")) for c in close]
    edges = close[0]
    for more in close[1:]:
        edges = edges.unionByName(more)
    if left:
        dealt = _dealt(members, "nd_band", F.lit(0), w).join(search.sketches, "nd_id")
        groups = max(1, -(-left // GROUP_ROWS))
        dealt = dealt.withColumn("nd_group", F.pmod("nd_block", F.lit(groups)))
        edges = edges.unionByName(dealt.groupBy("nd_group").applyInArrow(_close_pairs(search.close), "a long, b long"))
    families = w.adopt(components(w.write(edges, "near-close")))
    if not families.isEmpty():
        ids = w.write(search.with_class(families.select(F.col("id").alias("nd_id"), F.col("component").alias("nd_family"))), "near-families")
        sets = search.sets_of(ids.select("nd_id"))
        dealt = _dealt(sets.join(ids, "nd_id"), "nd_family", F.size("nd_items"), w)
        search.add(w.write(dealt.groupBy("nd_block").applyInArrow(_links(search.percent), "a long, b long"), "near-links"))
    return search.classes


def _mixed(search: Search, members: DataFrame) -> DataFrame:
    """The members, but the hub, of buckets that still hold several classes besides it, with the smallest member
    of another class than the hub's as the next one."""
    w = search.w
    hub_class = search.classes.select(F.col("id").alias("nd_hub"), F.col("component").alias("nd_hub_class"))
    rows = search.with_class(members.filter("nd_id <> nd_hub").select("nd_band", "nd_id", "nd_hub")).join(hub_class, "nd_hub", "left")
    rows = w.write(rows.withColumn("nd_other", F.when(F.col("nd_class") != F.coalesce("nd_hub_class", "nd_hub"), F.col("nd_id"))).select("nd_band", "nd_id", "nd_class", "nd_other"), "near-classed")
    size = rows.groupBy("nd_band").agg(F.min("nd_class").alias("lo"), F.max("nd_class").alias("hi"), F.min("nd_other").alias("nd_hub"))
    size = w.write(size.filter("lo <> hi").select("nd_band", "nd_hub"), "near-mixed")
    out = w.write(rows.join(size, "nd_band").select("nd_band", "nd_id", "nd_hub", "nd_class"), "near-members")
    w.free(rows, size)
    return out


def _dealt(rows: DataFrame, key: str, weight: Column, w: Workspace) -> DataFrame:
    """Rows (nd_id, nd_class) of a key dealt to pairs of blocks, named by ``nd_block``, so that all members of different classes meet.

    The largest class of a key has blocks of its own (``nd_main``), which meet the blocks of the rest but not each other."""
    size = rows.groupBy(key, "nd_class").agg(F.count("*").alias("d"), F.sum(weight).alias("s"))
    load = F.greatest(F.col("d") / BLOCK_DOCS, F.col("s") / BLOCK_SHINGLES)
    size = size.select(key, "nd_class", load.alias("load")).groupBy(key).agg(F.max(F.struct("load", "nd_class")).alias("m"), F.sum("load").alias("all"))
    parted = F.col("all") > 1
    size = size.select(
        key,
        F.when(parted, F.col("m.nd_class")).alias("nd_most"),
        F.when(parted, F.ceil("m.load")).otherwise(F.lit(0)).cast("int").alias("nd_q"),
        F.greatest(F.lit(1), F.when(parted, F.ceil(F.col("all") - F.col("m.load"))).otherwise(F.lit(1))).cast("int").alias("nd_r"),
    )
    size = w.write(size, "near-size")
    rows = rows.join(size, key).withColumn("nd_main", F.coalesce(F.col("nd_class") == F.col("nd_most"), F.lit(False)))
    rows = rows.withColumn("nd_k", F.pmod(F.xxhash64("nd_id"), F.when(F.col("nd_main"), F.col("nd_q")).otherwise(F.col("nd_r"))).cast("int"))
    among = lambda j: F.xxhash64(key, F.lit(0), F.least(j, F.col("nd_k")), F.greatest(j, F.col("nd_k")))
    across = lambda main, rest: F.xxhash64(key, F.lit(1), main, rest)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = F.array().cast("array<bigint>")
    of_main = F.transform(upto("nd_r"), lambda j: across(F.col("nd_k"), j))
    of_rest = F.concat(F.transform(upto("nd_r"), among), F.when(F.col("nd_q") > 0, F.transform(upto("nd_q"), lambda j: across(j, F.col("nd_k")))).otherwise(none))
    rows = rows.withColumn("nd_block", F.explode(F.when(F.col("nd_main"), of_main).otherwise(of_rest)))
    return rows.drop("nd_most", "nd_q", "nd_r", "nd_k", key)


def _forest(near: np.ndarray, ids: np.ndarray, a: list[int], b: list[int]) -> None:
    """Adds a spanning forest of the graph ``near`` (a symmetric boolean matrix)."""
    free = near.any(axis=1)
    for start in np.flatnonzero(free):
        if not free[start]:
            continue
        free[start], todo = False, [start]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & free)
            free[new] = False
            todo += new.tolist()
            a += ids[new].tolist()
            b += [int(ids[at])] * len(new)


def _meets(classes: np.ndarray, main: np.ndarray) -> np.ndarray:
    """Which members of a block are to be compared: those of different classes; in a block of the largest class, that with the rest."""
    out = classes[:, None] != classes[None, :]
    return out & (main[:, None] != main[None, :]) if main.any() else out


def _close_pairs(close: float):
    """Of bucket blocks, a few of them a group: spanning forests of the members of different classes whose sketches are alike."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, ids = table["nd_block"].to_numpy(), table["nd_id"].to_numpy()
        order = np.lexsort((ids, block))
        block, ids = block[order], ids[order]
        classes, main = table["nd_class"].to_numpy()[order], np.array(table["nd_main"].to_pylist(), bool)[order]
        tails = np.frombuffer(b"".join(table["nd_bytes"].to_pylist()), np.uint8).reshape(-1, COORDINATES)[order]
        cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1, append=block[-1] + 1))
        a, b = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            meets = _meets(classes[lo:hi], main[lo:hi])
            if not meets.any():
                continue
            own = tails[lo:hi]
            for i in range(hi - lo):
                others = np.flatnonzero(meets[i, i + 1 :]) + i + 1
                meets[i, i + 1 :] = False
                meets[i, others] = _similarity((own[others] == own[i]).mean(axis=1)) >= close
                meets[i + 1 :, i] = meets[i, i + 1 :]
            _forest(meets, ids[lo:hi], a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links(percent: int):
    """Of a block: a spanning forest of the links between classes, each checked on the full sets."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, classes, main = table["nd_id"].to_numpy(), table["nd_class"].to_numpy(), np.array(table["nd_main"].to_pylist(), bool)
        column = table["nd_items"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        sizes = np.diff(offsets)
        rows = np.repeat(np.arange(len(ids)), sizes)
        _, cols = np.unique(values[offsets[0] : offsets[-1]], return_inverse=True)
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        both = np.zeros((len(ids), len(ids)), np.float32)
        width = 2048
        for at in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
            lo, hi = np.searchsorted(cols, [at, at + width])
            part = np.zeros((len(ids), width), np.float32)
            part[rows[lo:hi], cols[lo:hi] - at] = 1
            some = np.flatnonzero(part.any(axis=1))
            part = part[some]
            both[np.ix_(some, some)] += part @ part.T
        union = sizes[:, None] + sizes[None, :] - both
        a, b = [], []
        _forest((100 * both >= percent * union) & _meets(classes, main), ids, a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _classified(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``classes`` with ``nd_text``, the hash of the row's text."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("nd_text"), "text")
    with Workspace(docs.sparkSession) as w:
        features = w.write(map_batches(docs, _features(width), _FEATURES), "near-features")
        nodes = nodes_of(features, w)
        linked = find_links(Search(docs, nodes, width, percent, w))
        member = nodes.select("nd_set", "nd_id", "nd_doc").join(linked, nodes["nd_id"] == linked["id"])
        member = w.write(member.select("nd_set", "nd_doc", "component"), "near-classes")
        smallest = w.write(member.groupBy("component").agg(F.min("nd_doc").alias("nd_first")), "near-smallest")
        first = member.join(smallest, "component").select(F.col("nd_set").alias("nd_linked"), "nd_first")
        first = nodes.select("nd_set", "nd_doc").join(first, F.col("nd_set") == F.col("nd_linked"), "left")
        first = w.write(first.select(F.col("nd_set").alias("nd_key"), F.coalesce("nd_first", "nd_doc").alias("nd_first")), "near-first")
        out = features.join(first, features["nd_set"] == first["nd_key"], "left")
        component = F.when(F.col("nd_set").isNull(), F.col("doc_id")).otherwise(F.col("nd_first"))
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), "nd_text")
        return w.result(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), features, first)


def classes(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    return _classified(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest ``doc_id``."""
    gone = _classified(docs, width, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("nd_gone"), F.col("nd_text").alias("nd_gone_text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["nd_gone"]) & (F.xxhash64(docs["text"]) == gone["nd_gone_text"]), "left_anti")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir).select("doc_id", "text"), width=2)


OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(g) AS h FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(h) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM c JOIN n USING (doc_id)
"""
