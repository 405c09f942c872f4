"""Near-duplicates by b-bit MinHash.

A document is the set of its distinct word shingles. Equal sets fold into one node first. Minima of HASHES permutations are
cut into bands; nodes that share a band are candidates. Of each minimum only BITS low bits are kept, packed into signatures,
and the similarity of a candidate pair is estimated from the count of equal cells, corrected for cells that are equal by
chance; only pairs that could not reach the similarity (with a chance under MISS) are dropped. The others are confirmed on
their full sets, and linked nodes form components.

Beside its signature a node carries the parities of its shingles in ODD bins. A bin whose parities differ holds a shingle of
only one of the two sets, so bit counts bound the difference of the sets from below; a pair beyond what the similarity allows
is dropped without loss, before any full set moves.

No pairs are made inside a group of copies: in rounds over a few bands each, nodes outside the largest component of a bucket
meet one member of it, two such pairs a node and round at most are confirmed, and components are joined. Buckets whose members
then still lie in different components are compared member by member across components, with size and estimate inside the
join, so that only pairs which may be links leave it. A link of similarity s escapes all bands with a chance of (1 - s ** ROWS) ** BANDS, under
2e-10 at 0.8.

Documents without words or text, and rows without an id, are linked with nothing; the latter get no component and are kept.
Rows of one id are separate documents that share a name. Ties and repeated rows are copies. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.llm.common import Cache, lower_words, shared_folder, text_of, written

BANDS, ROWS, BITS = 32, 3, 2
HASHES = BANDS * ROWS
#: Bands whose buckets' heads are met, round by round, before buckets are compared member by member.
ROUNDS = ((0, 6), (6, BANDS))
#: Bins of the parity sketch.
ODD = 512
MISS = 1e-9
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_C = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def word_hashes() -> Cache:
    """Hashes of words met by one task, which end with it."""
    return Cache(lambda w: xxhash.xxh3_64_intdigest(w), 100_000)


def shingle_set(text: str, k: int, hashes: Cache | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word k-grams; of the whole sequence if it is shorter."""
    hashes = word_hashes() if hashes is None else hashes
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mixed(out * _P + h[j:len(h) - n + 1 + j])
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        v = low[None, at:at + 4096] * _A[:, None]
        v ^= v >> np.uint32(15)
        v *= _C[:, None]
        v ^= v >> np.uint32(13)
        np.minimum(best, v.min(axis=1), out=best)
    return best


def bands_and_bits(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of all bands, and packed low bits, for rows of minima."""
    keys = np.zeros((len(low), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mixed(keys * _P + low[:, r::ROWS])
    cells = 64 // BITS
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    packed = np.zeros((len(low), HASHES // cells), np.uint64)
    for i in range(HASHES):
        packed[:, i // cells] |= bits[:, i] << np.uint64(BITS * (i % cells))
    return keys, packed


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each bin of the set holds an odd number of shingles, packed into 64-bit words."""
    odd = (np.bincount((shingles % np.uint64(ODD)).astype(np.int64), minlength=ODD) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def least_equal(similarity: float) -> int:
    """Fewest equal cells that a pair of that similarity shows but for a chance under MISS."""
    p = 2.0 ** -BITS + (1 - 2.0 ** -BITS) * similarity
    total = 0.0
    for equal in range(HASHES + 1):
        total += math.comb(HASHES, equal) * p ** equal * (1 - p) ** (HASHES - equal)
        if total >= MISS:
            return equal
    return HASHES


def equal_cells(a: list[Column], b: list[Column]) -> Column:
    """Equal cells of two packed signatures, by bit counts."""
    out = F.lit(HASHES)
    every = sum(1 << BITS * i for i in range(64 // BITS))
    every -= 1 << 64 if every >> 63 else 0
    for x, y in zip(a, b):
        differ = x.bitwiseXOR(y)
        cell = differ
        for i in range(1, BITS):
            cell = cell.bitwiseOR(F.shiftrightunsigned(differ, i))
        out = out - F.bit_count(cell.bitwiseAND(F.lit(every)))
    return out


def differing(a: list[Column], b: list[Column]) -> Column:
    """Bins whose parities differ: at most the shingles that only one of both sets holds."""
    out = F.lit(0)
    for x, y in zip(a, b):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def estimated(equal: Column) -> Column:
    """Similarity from the share of equal cells, less what chance makes equal."""
    chance = 2.0 ** -BITS
    return (equal / HASHES - chance) / (1 - chance)


WORDS, ODDS = HASHES * BITS // 64, ODD // 64
PACKED, SKETCH = [f"s{i}" for i in range(WORDS)], [f"p{i}" for i in range(ODDS)]
SIGNED = "id long, tie long, node long, n long, " + ", ".join(f"{c} long" for c in PACKED + SKETCH) + ", bands array<long>"


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tie (digest of the text), node (names the set; null for empty sets), n (size of the set), packed signature, parity sketch, band keys."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t, k, hashes) for t in part.column(2).to_pylist()]
                low = np.array([minima(s) for s in sets], dtype=np.uint32)
                keys, packed = bands_and_bits(low)
                odd = np.array([parities(s) for s in sets])
                empty = np.array([not len(s) for s in sets])
                node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                ends = pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(node, mask=empty), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(packed[:, i].view(np.int64)) for i in range(WORDS)],
                     *[pa.array(odd[:, i].view(np.int64)) for i in range(ODDS)],
                     pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel()))],
                    ["id", "tie", "node", "n", *PACKED, *SKETCH, "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("tie"), text_of(text_col).alias("text")).mapInArrow(signed, SIGNED)


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node, root (smallest node reachable) of every node in edges (a, b). Each round every root moves to its smallest neighbour, chains of moves are shortened, and edges inside a root go."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), folder, f"{name}-edges-0")
    both = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
    roots = both(edges).select("node").distinct().withColumn("root", F.col("node"))
    number = 0
    while not edges.isEmpty():
        number += 1
        moves = written(both(edges).groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")), folder, f"{name}-moves-{number}-0")
        jump = 0
        while True:
            jump += 1
            next_ = moves.select(F.col("node").alias("root"), F.col("root").alias("further"))
            moves = written(moves.join(next_, "root", "left").select("node", F.coalesce("further", "root").alias("root"), (F.col("further") < F.col("root")).alias("moved")), folder, f"{name}-moves-{number}-{jump}")
            done = moves.filter("moved").isEmpty()
            moves = moves.select("node", "root")
            if done:
                break
        to = moves.select(F.col("node").alias("root"), F.col("root").alias("new"))
        roots = written(roots.join(to, "root", "left").select("node", F.coalesce("new", "root").alias("root")), folder, f"{name}-roots-{number}")
        for side in ("a", "b"):
            edges = edges.join(to.withColumnRenamed("root", side), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), folder, f"{name}-edges-{number}")
    return roots


#: Bits of the mark that keeps most other texts out of a join: 8 MB in all, whatever the corpus.
MARK_BITS = 1 << 26


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (column id) whose id may be among `ids`: none that is among them is lost, few others stay while ids are fewer than bits."""
    bit = F.pmod(F.xxhash64("id"), F.lit(MARK_BITS)) + 1
    place = F.bitmap_bit_position(bit)
    mark = ids.select(F.bitmap_bucket_number(bit).alias("mark_bucket"), place.alias("place")).groupBy("mark_bucket").agg(F.bitmap_construct_agg("place").alias("mark"))
    byte = F.conv(F.hex(F.substring("mark", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = rows.join(F.broadcast(mark), F.bitmap_bucket_number(bit) == F.col("mark_bucket"))
    return held.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def full_sets(nodes: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """node, shingles (the whole set) of the nodes, each from the text of its first document."""
    wanted = nodes.select("node", F.col("first_doc").alias("id"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, k, hashes) for t in part.column(1).to_pylist()]
                own = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                right = own == part.column(0).to_numpy(zero_copy_only=False)  # another row of the same id
                sets = [s for s, r in zip(sets, right) if r]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[right]), pa.ListArray.from_arrays(ends, pa.array(values))], ["node", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    texts = marked(texts, wanted).join(wanted, "id").select("node", "text")
    return texts.mapInArrow(rebuilt, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose full sets are similar enough, as (a, b). Nodes of rows that repeat an id may have their set twice."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    return joined.filter(100 * F.col("both") >= percent * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b")


def may_link(percent: int) -> Column:
    """Whether sizes, parities and estimate of n_a, n_b, s*_a, ... allow a link. Sizes and parities are bounds; the estimate errs with a chance under MISS."""
    side = lambda names, x: [F.col(f"{c}_{x}") for c in names]
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    apart = (100 + percent) * differing(side(SKETCH, "a"), side(SKETCH, "b")) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    return sizes & (equal_cells(side(PACKED, "a"), side(PACKED, "b")) >= least_equal(percent / 100)) & apart


def linked_rows(docs: DataFrame, folder: str | None = None, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tie, n (size of the set), root (names the component; null for rows linked with nothing by rule), lowest (its smallest id), one row a document."""
    folder = folder or shared_folder(docs.sparkSession)
    signed = written(signatures(docs, k, id_col, text_col), folder, "signatures")
    kinds = ["n", *PACKED, *SKETCH]
    linked = signed.filter("node IS NOT NULL AND id IS NOT NULL")
    nodes = written(linked.groupBy("node").agg(F.min("id").alias("first_doc"), *[F.first(c).alias(c) for c in (*kinds, "bands")]), folder, "nodes")
    every = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    held = every.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1").withColumnRenamed("bucket", "in_bucket")
    shared = written(every.join(held, F.col("bucket") == F.col("in_bucket")).select("bucket", F.col("band").cast("byte").alias("band"), "node", "held"), folder, "shared")
    weights = shared.groupBy("node").agg(F.sum("held").alias("weight"))  # what copies were made from shares the most buckets with them
    near = written(nodes.join(weights, "node").select("node", "first_doc", "weight", *kinds), folder, "near")
    small = near.select("node", *kinds)
    sets = written(full_sets(near, docs, k, id_col, text_col), folder, "sets")

    def compared(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) where sizes, parities and estimate allow a link."""
        for x in "ab":
            pairs = pairs.join(small.withColumnsRenamed({c: f"{c}_{x}" for c in kinds} | {"node": x}), x)
        return pairs.filter(may_link(percent)).select("a", "b")

    def placed(roots: DataFrame | None, begin: int, end: int) -> DataFrame:
        """bucket, node, weight, root of all nodes that share buckets, for bands begin to end - 1."""
        own = near.select("node", "weight")
        own = own.withColumn("root", F.col("node")) if roots is None else own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        return shared.filter((F.col("band") >= begin) & (F.col("band") < end)).select("bucket", "node").join(own, "node")

    def mixed(members: DataFrame) -> DataFrame:
        """Buckets with several components: the largest of them there, and its node of most weight there."""
        by_root = members.groupBy("bucket", "root").agg(F.count("*").alias("held"), F.max(F.struct("weight", "node")).alias("head"))
        main = F.max_by(F.struct("root", "head"), F.struct("held", "head")).alias("m")
        return by_root.groupBy("bucket").agg(F.count("*").alias("roots"), main).filter("roots > 1").select(F.col("bucket").alias("in_bucket"), F.col("m.root").alias("main"), F.col("m.head.node").alias("head"), F.col("m.head.weight").alias("head_weight"))

    edges, roots = None, None
    for begin, end in ROUNDS:  # nodes outside a bucket's largest component meet that component's head
        members = placed(roots, begin, end)
        inside = mixed(members)
        met = members.join(inside, (F.col("bucket") == F.col("in_bucket")) & (F.col("root") != F.col("main"))).groupBy(F.col("node").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("bands"), F.max("head_weight").alias("weight"))
        best = met.groupBy("a").agg(F.max_by("b", F.struct("bands", "b")).alias("x"), F.max_by("b", F.struct("weight", "b")).alias("y")).select("a", F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))
        best = written(compared(best), folder, f"best-{begin}")
        if best.isEmpty():
            continue
        found = written(confirmed(best, sets, percent), folder, f"edges-{begin}")
        edges = found if edges is None else edges.unionByName(found)
        roots = components(edges, folder, f"heads-{begin}")

    members = placed(roots, 0, BANDS)  # what is still apart is compared member by member
    apart = members.join(mixed(members), F.col("bucket") == F.col("in_bucket")).select("bucket", "node", "root", "main")
    apart = written(apart.join(small, "node"), folder, "apart")
    a = apart.filter("root <> main").select(F.col("bucket").alias("bucket_a"), "main", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", *kinds)])
    b = apart.select(F.col("bucket").alias("bucket_b"), *[F.col(c).alias(f"{c}_b") for c in ("node", "root", *kinds)])
    once = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main")) | (F.col("node_a") < F.col("node_b")))
    rest = a.join(b, (F.col("bucket_a") == F.col("bucket_b")) & once & may_link(percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    rest = written(rest, folder, "rest")
    if not rest.isEmpty():
        found = confirmed(rest, sets, percent)
        roots = components(found if edges is None else edges.unionByName(found), folder, "rest")

    if roots is None:
        roots = nodes.select("node", F.col("node").alias("root")).filter("false")
    whole = nodes.select("node", "first_doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = whole.groupBy("root").agg(F.min("first_doc").alias("lowest"))
    named = whole.join(lowest, "root").select(F.col("node").alias("own"), "root", "lowest")
    out = signed.select("id", "tie", "n", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")).join(named, F.col("node") == F.col("own"), "left")
    return out.select("id", "tie", "n", "root", "lowest")


def near_duplicates(docs: DataFrame, folder: str | None = None, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (whether the document is that one), one row a document."""
    component = F.coalesce("lowest", "id")
    return linked_rows(docs, folder, k, percent, id_col, text_col).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns: one row of each component, of smallest id and then smallest digest of the text, and those linked with nothing.

    Rows are told apart by id and text: rows that repeat an id with another text stand for themselves, and of rows equal in both one stays. Rows without an id or without words all stay.
    """
    folder = shared_folder(docs.sparkSession)
    rows = written(linked_rows(docs, folder, k, percent, id_col, text_col).filter("root IS NOT NULL").groupBy("root", "id", "tie").agg(F.count("*").alias("times")), folder, "decided")
    first = rows.groupBy("root").agg(F.min(F.struct("id", "tie")).alias("first")).select(F.col("root").alias("of"), "first")
    rows = rows.join(first, F.col("root") == F.col("of")).select("id", "tie", "times", (F.struct("id", "tie") == F.col("first")).alias("stays"))
    own_id, own_tie = (next(n for n in (f"__{c}{'_' * i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for c in ("id", "tie"))
    keyed = docs.withColumn(own_id, F.col(id_col).cast("long")).withColumn(own_tie, F.xxhash64(text_of(text_col)))
    met = lambda table: (F.col(own_id) == table["id"]) & (F.col(own_tie) == table["tie"])
    apart, repeated = rows.filter("NOT stays OR times > 1"), rows.filter("stays AND times > 1")
    single = keyed.join(apart, met(apart), "left_anti")
    once = keyed.join(repeated, met(repeated), "left_semi").dropDuplicates([own_id, own_tie])
    return single.unionByName(once).select(*docs.columns)
