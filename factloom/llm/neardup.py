"""MinHash near-dedup: one-permutation hashing with optimal densification, bands, and star-shaped candidate edges.

A document's set holds its distinct 5-word shingles (lower-cased A-Z words; all words as one shingle if fewer than five).
One hash per shingle fills BINS bins with minima; an empty bin takes the value of the first full bin in its own fixed
random order. Documents with equal sets form a class first, so copies never meet in buckets. Bands of ROWS bins put
classes into buckets; each bucket gives a star: edges from its centre to the others, never all pairs.

A link is confirmed on the full sets (100 * intersection >= 75 * union). So that no link between two members is lost when
the centre is not the right one, buckets whose members are still in different components are worked on further, exactly:

* A shingle that no other component of the open buckets holds can't be shared with one. If the others bound a member's
  similarity below 0.75, all its open pairs are refuted and it leaves its bucket.
* If only the shingles of more than RARE holders bound it so, a link must share a rarer one: the member is compared with the
  few holders of its rare shingles and leaves.
* What is left after PEELS such (linear) steps goes through rounds of further stars, 64 times as many centres each round, over
  pairs that aren't joined and that the first bound leaves possible. Each member has left or been a centre once when the
  rounds end. The members of a large bucket are dealt out in slices, each met by all of the round's centres.

So every pair that shares a bucket is joined or refuted on its sets and sizes alone. A pair at exactly 0.75 shares none of the 32
buckets with probability below 1e-5 (README has the recall measured against brute force).

Classes are keyed by a 64-bit fingerprint of their set (two sets of n get the same one with probability of about n**2 / 2**65).
Sets are read once more after signing, for classes that share a bucket with another one, and kept as a checkpoint.

Defined cases: null or blank text is an empty set and linked with nothing; repeated rows are copies of one class; rows of
one doc_id that have words are one node, and a null doc_id is a node of its own, linked with nothing; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

WIDTH = 5
THRESHOLD_PCT = 75
BINS = 256
BANDS, ROWS = 32, 4
GROWTH = 64
#: How often members out of reach leave before centres are taken.
PEELS = 2
#: Holders of a rare shingle at most.
RARE = 32
#: Members of a slice of a bucket.
SLICE = 2048

_rng = np.random.default_rng(20240501)
_ORDER = np.array([_rng.permutation(BINS) for _ in range(BINS)])
_SIGNATURE = "doc_id long, n long, id long, bands array<long>"


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted by document and value, distinct; number of each document)."""
    w = C.Words(raw, off, lower=True)
    n = w.counts()
    starts, doc = C.per_document_windows(w.first, WIDTH)
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    begin = np.concatenate([starts, w.first[short]])
    end = np.concatenate([starts + WIDTH, w.first[short + 1]])
    doc = np.concatenate([doc, short])
    h = C.ranges_hash(w.hashes(), begin, end)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(off) - 1)


def fingerprints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each non-empty set, from two sums over its shingles and its size."""
    first = np.cumsum(n) - n
    if not len(h):
        return np.empty(0, np.uint64)
    one, two = np.add.reduceat(h, first), np.add.reduceat(C.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
    return C.mix(one ^ C.mix(two + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def signatures(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Band keys of non-empty sets."""
    doc = np.repeat(np.arange(len(n)), n)
    bin_ = (h >> np.uint64(56)).astype(np.int64)
    cell = doc * BINS + bin_
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    minima = np.zeros(len(n) * BINS, np.uint64)
    minima[cell[new]] = h[new]
    full = np.zeros(len(n) * BINS, bool)
    full[cell[new]] = True
    minima, full = minima.reshape(-1, BINS), full.reshape(-1, BINS)
    part = np.flatnonzero(~full.all(axis=1))
    have = full[part]
    source = np.empty((len(part), BINS), np.int64)
    for j in range(BINS):
        source[:, j] = np.where(have[:, j], j, _ORDER[j][have[:, _ORDER[j]].argmax(axis=1)])
    minima[part] = np.take_along_axis(minima[part], source, axis=1)
    keyed = minima[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    bands = np.zeros(keyed.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        bands = C.mix((bands ^ keyed[:, :, r]) * np.uint64(0x9E3779B97F4A7C15))
    return bands


def _sign(docs: DataFrame) -> DataFrame:
    def run(batches):
        C.release()
        for b in batches:
            raw, off = C.utf8(b.column(1))
            for i, j, part, at in C.pieces(raw, off):
                h, n = shingle_sets(part, at)
                some = np.flatnonzero(n)
                ids = np.zeros(len(n), np.int64)
                ids[some] = fingerprints(h, n[some]).view(np.int64)
                bands = signatures(h, n[some])
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                arrays = [b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(ids, mask=n == 0), pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1).view(np.int64)))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "id", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, _SIGNATURE)


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, s binary): the fingerprint and the sorted set of each row whose doc_id is asked for."""

    def run(batches):
        C.release()
        for b in batches:
            raw, off = C.utf8(b.column(1))
            for i, j, part, at in C.pieces(raw, off):
                h, n = shingle_sets(part, at)
                ends = np.concatenate([[0], np.cumsum(n)])
                some = np.flatnonzero(n)
                ids = fingerprints(h, n[some]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([h[ends[k] : ends[k + 1]].tobytes() for k in some.tolist()], pa.binary())], ["id", "s"])

    return docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(run, "id long, s binary")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs whose sets reach the threshold."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum()) if len(q) else 0
                keep.append(both > 0 and 100 * both >= THRESHOLD_PCT * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.withColumnsRenamed({"id": "a", "s": "sa"}), sets.withColumnsRenamed({"id": "b", "s": "sb"})
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _possible(x: str, y: str):
    """Whether the sizes of two classes leave a link possible."""
    return F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * THRESHOLD_PCT


class _Links:
    """Sets of the classes that share buckets, and confirmed components so far: (v, root)."""

    def __init__(self, sets: DataFrame, given: DataFrame, n_given: int):
        self.sets, self.roots, self.n = sets, None, 0
        if n_given:  # links that hold whatever the sets say
            self.roots, self.n = components(given)

    def confirm(self, pairs: DataFrame) -> None:
        """Verifies (a, b) pairs of classes and joins their components."""
        links, n = C.counted(_linked(pairs, self.sets))
        if not n:
            return
        if self.roots is None:
            self.roots, self.n = components(links)
            return
        ends = self.rooted(self.rooted(links, "a"), "b")
        joined, n = components(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        moved = self.roots.join(C.sized(joined.select(F.col("v").alias("root"), F.col("root").alias("now")), n), "root", "left").select("v", F.coalesce("now", "root").alias("root"))
        self.roots, self.n = C.counted(moved.unionByName(joined))

    def reach(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Over the sets of the given ids: (id, u, v) and (h, id, root) of rare shingles.

        u: shingles that only the id's own component holds; v: those and the rare ones, of RARE holders at most.
        """

        def shingles(batches):
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    part = b.slice(i, 512)
                    sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
                    n = [len(x) for x in sets]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), *(pa.array(np.repeat(part.column(k).to_numpy(), n)) for k in (0, 1))], ["h", "id", "root"])

        held = self.rooted(self.sets.join(ids, "id", "left_semi"), "id").select("id", F.col("id_root").alias("root"), "s")
        each = held.mapInArrow(shingles, "h long, id long, root long")
        kinds = each.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("k"))
        kinds = kinds.where((F.col("r0") == F.col("r1")) | (F.col("k") <= RARE)).select("h", (F.col("r0") == F.col("r1")).alias("own"))
        few = C.cut(each.join(kinds, "h"))
        return few.groupBy("id").agg(F.count_if("own").alias("u"), F.count(F.lit(1)).alias("v")), few.where("NOT own").select("h", "id", "root")

    def rooted(self, df: DataFrame, column: str) -> DataFrame:
        if self.roots is None:
            return df.withColumn(f"{column}_root", F.col(column))
        named = C.sized(self.roots.withColumnsRenamed({"v": column, "root": "_r"}), self.n)
        return df.join(named, column, "left").withColumn(f"{column}_root", F.coalesce("_r", column)).drop("_r")


def _mixed(links: _Links, open_: DataFrame) -> tuple[DataFrame, int]:
    """Rows of buckets whose members are in different components, and their number."""
    C.free_shuffles(open_.sparkSession)
    now = links.rooted(open_, "id")
    mixed = now.groupBy("key").agg(F.min("id_root").alias("r0"), F.max("id_root").alias("r1")).where("r0 <> r1").select("key")
    return C.counted(now.join(C.sized(*C.counted(mixed)), "key", "left_semi").select(*open_.columns))


def _peeled(links: _Links, open_: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of members that aren't settled by what they can share with other components."""
    counts, rare = links.reach(C.counted(open_.select("id").distinct())[0])
    now = open_.drop("m").join(counts, "id", "left").withColumn("m", F.col("n") - F.coalesce("u", F.lit(0))).withColumn("common", F.col("n") - F.coalesce("v", F.lit(0)))
    least = open_.groupBy("key").agg(F.min("n").alias("n_min"))
    # a partner has n_min shingles at least, and no fewer than what is shared
    can = lambda m: F.col(m) * 100 >= (F.col("n") + F.greatest("n_min", m) - F.col(m)) * THRESHOLD_PCT
    now = C.cut(now.join(least, "key").where(can("m")).withColumn("stays", can("common")).select(*open_.columns, "stays"))
    some = now.where("NOT stays").groupBy("id").agg(F.min("m").alias("m"))
    left = rare.join(some, "id").join(facts, "id").alias("x")
    right = rare.join(facts, "id").alias("y")
    reachable = F.col("x.m") * 100 >= (F.col("x.n") + F.col("y.n") - F.col("x.m")) * THRESHOLD_PCT
    pairs = left.join(right, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & reachable & _possible("x", "y"))
    pairs, n = C.counted(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    if n:
        links.confirm(pairs)
    return now.where("stays").select(*open_.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = C.cut(_sign(d))
    named = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes, n_classes = C.counted(named.groupBy("id").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    facts = C.sized(classes.select("id", "n"), n_classes)
    members = classes.select("id", F.explode("bands").alias("key"))
    buckets = C.sized(*C.counted(members.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")))
    shared = C.cut(members.join(buckets, "key"))
    C.free_shuffles(spark)
    # the sets of classes that share a bucket, read once
    wanted = shared.select("id").distinct().join(classes.select("id", F.col("least").alias("doc_id")), "id").select("doc_id").distinct()
    again = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("a"), F.max("id").alias("b")).where("rows > 1")
    again, n_again = C.counted(again)
    sets = _sets_of(d, C.sized(*C.counted(wanted)))
    links = _Links(C.cut(sets.dropDuplicates(["id"]) if n_again else sets), *_same_node(named, again, n_again))
    stars = shared.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    near = stars.join(facts.alias("x"), F.col("a") == F.col("x.id")).join(facts.alias("y"), (F.col("b") == F.col("y.id")) & _possible("x", "y"))
    links.confirm(C.counted(near.select("a", "b"))[0])
    _settle(links, shared, classes, n_classes, facts)
    # a component is named by the least doc_id of its classes
    least = classes.select("id", "least")
    if links.roots is not None:
        ends = links.roots.select("v", "root").unionByName(links.roots.select(F.col("root").alias("v"), "root")).distinct()
        ends = ends.join(least, F.col("v") == F.col("id"))
        named_roots = ends.groupBy("root").agg(F.min("least").alias("component"))
        least = least.join(C.sized(ends.join(named_roots, "root").select(F.col("v").alias("id"), "component"), 2 * links.n), "id", "left")
        least = least.select("id", F.coalesce("component", "least").alias("least"))
    out = signed.select("doc_id", "n", "id").join(least, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _same_node(named: DataFrame, again: DataFrame, n_again: int) -> tuple[DataFrame, int]:
    """(a, b) links between classes that share a doc_id."""
    own = again.where("a <> b").select("doc_id", "a")
    return C.counted(named.select("doc_id", "id").join(C.sized(own, n_again), "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()) if n_again else (again, 0)


def _settle(links: _Links, shared: DataFrame, classes: DataFrame, n_classes: int, facts: DataFrame) -> None:
    """Joins or refutes every pair of classes that shares a bucket."""
    signs = C.sized(classes.select("id", "bands"), n_classes)
    share = (F.xxhash64("key", "id").bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    open_ = shared.join(facts.select("id", "n"), "id").select("key", "id", "size", share.alias("turn"), "n", F.col("n").alias("m"))
    open_, n = _mixed(links, open_)
    for _ in range(PEELS):
        if not n:
            break
        before = n
        open_ = _peeled(links, open_, facts)
        open_, n = _mixed(links, open_)
        if n > 0.8 * before:
            break
    low, most = 0.0, 1.0
    while n:
        # members whose turn (a fixed random number) lies in [low, most) / size are this round's centres
        # a pair is looked at in the least bucket it shares, once: by the first of the two to be a centre there
        place = F.col("turn") * F.col("size")
        held = links.rooted(open_, "id").join(signs, "id").withColumn("place", place).where(F.col("place") >= low)
        slices = F.greatest(F.floor(F.col("size") / SLICE), F.lit(1))
        centre = held.where(F.col("place") < most).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).alias("x")
        others = held.withColumn("slice", F.pmod(F.xxhash64("id"), slices)).alias("y")
        once = (F.col("y.place") >= most) | (F.col("x.id") < F.col("y.id"))
        least = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")
        shared_most = F.least("x.m", "y.m")
        reachable = shared_most * 100 >= (F.col("x.n") + F.col("y.n") - shared_most) * THRESHOLD_PCT
        met = (F.col("x.key") == F.col("y.key")) & (F.col("x.slice") == F.col("y.slice")) & (F.col("x.id_root") != F.col("y.id_root"))
        pairs = centre.join(others, met & once & reachable & least)
        pairs, k = C.counted(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
        if k:
            links.confirm(pairs)
        # a bucket is done when its last member has been a centre
        open_, n = _mixed(links, open_.where(F.col("size") > most))
        low, most = most, most * GROWTH


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))


_SETS = r"""SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE
    list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents)"""
ORACLE = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE d AS ({_SETS}),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM d),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS k FROM g x JOIN g y USING (t) WHERE x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (n + m - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.v WHERE r.root < l.b),
c AS (SELECT v, min(root) AS component_id FROM r GROUP BY v)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c ON c.v = d.doc_id"""
}
QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup}
