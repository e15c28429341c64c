"""SimHash fingerprints of word shingles, and near-duplicates by meeting in the middle of Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, dropped, stored, table

#: Sketches of a text and the shingles in each: with a similarity of 0.8 two texts share one of them in 99.98 of 100 cases.
SKETCHES, IN_SKETCH = 16, 4
_MIX = [int(x) | 1 for x in np.random.default_rng(64).integers(1 << 62, 1 << 63, SKETCHES)]
#: Bins of a signature: one byte of the least shingle hash in each, zero where there is none.
BINS = 128
#: Members of a group that are paired as rows, and how often those of a larger one are compared with one of them before its
#: different components are compared whole, in blocks of about so many bytes of shingles.
SMALL, TURNS, BLOCK_BYTES = 32, 3, 1 << 25

#: Shingle hashes whose bits are counted in one go.
BLOCK = 1 << 14


def simhash(text: str | None, shingle: int) -> int:
    """64-bit fingerprint as a signed number; zero if there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six white-space bytes only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array((simhash(t.as_py(), shingle) for t in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """Signed 64-bit masks with at most `radius` bits."""
    found = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def ball_links(distinct: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that join all of the distinct fingerprints (fp) of at most `distance` differing bits, one star a variant."""
    if distance % 2:
        raise ValueError("distance must be even: its half is the radius of the balls")
    ball = F.expr(f"cast(split('{','.join(map(str, masks(distance // 2)))}', ',') AS array<bigint>)")
    variants = distinct.select("fp", F.explode(ball).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.groupBy("variant").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    links = met.select(F.col("fps")[0].alias("b"), F.explode(F.slice("fps", 2, 1 << 20)).alias("a"))
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links of at most `distance` bits) of every row.

    Each distinct fingerprint emits all variants within half the distance; two fingerprints of at most that distance
    share a variant, and all that share one are within the distance of each other, so a variant's fingerprints (65 at
    most for distance 2) are one clique and a star to their least one loses no link. Copies meet once, as one
    fingerprint, so a large group of copies costs what one text costs. Null and empty texts have fingerprint zero and
    are linked like any other. Rows with a null doc_id keep it and never name a component unless all its rows do.
    Repeated rows come out as often as they go in; an empty table gives no rows.
    """
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(ball_links(distinct.select("fp"), distance))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id")  # two plain scans: a hot fingerprint's side can be split


def _bits(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if it is set in over half of them."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.uint32) > len(hashes), bitorder="little").view("<i8")[0])


def shingle_hashes(text: str | None, shingle: int) -> tuple[int, np.ndarray]:
    """A hash of a text's words, and the hashes of its shingles in order, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return digest(b" ".join(words), 7) - (1 << 63), np.fromiter((digest(g, 42) for g in grams), np.uint64)


def _folded_bits(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def sketches(text: str | None, shingle: int) -> tuple[int, int, list[int], bytes]:
    """Of a text: a hash of its words, its fingerprint, fingerprints of small samples of its shingles, and its signature.

    A sample has the shingles that come first in an order of its own, so that alike texts often have the same. The
    signature has a byte of the least hash in each of BINS ranges: the share of equal bytes estimates the similarity."""
    node, all_ = shingle_hashes(text, shingle)
    if not len(all_):
        return node, 0, [], bytes(BINS)
    h = np.unique(all_)
    own = []
    for place, mix in enumerate(_MIX):
        order = h * np.uint64(mix)
        order ^= order >> np.uint64(32)
        k = min(IN_SKETCH, len(h))
        own.append((_bits(np.sort(h[np.argpartition(order, k - 1)[:k]])) ^ mix * (place + 1)) % (1 << 64))
    at = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    first = h[np.minimum(at, len(h) - 1)]
    byte = np.where((first >> np.uint64(57)) == np.arange(BINS), (first >> np.uint64(20)) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)
    return node, _folded_bits(all_), [x - (1 << 64) if x >> 63 else x for x in own], byte.tobytes()


def _text_hash() -> Column:
    return F.xxhash64("text")


def _alike(pairs: DataFrame, signatures: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose signatures don't speak against the similarity: four standard deviations below it at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
            used = ((x > 0) | (y > 0)).sum(axis=1)
            least = similarity - 4 * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1))
            yield batch.filter(pa.array(((x == y) & (x > 0)).sum(axis=1) >= least * used)).select([0, 1])

    with_a = pairs.join(signatures.selectExpr("node AS a", "signature AS x").hint("merge"), "a")
    both = with_a.join(signatures.selectExpr("node AS b", "signature AS y").hint("merge"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sets(asked: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): the different shingle hashes, sorted, of the nodes in asked (node); a stored table.

    One text is read for each node: the one with the node's least doc_id."""
    wanted = nodes.select("node", "least", "text_hash").hint("merge").join(asked, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                rows = whole.slice(k, 256)
                found = [shingle_hashes(t.as_py(), shingle) for t in rows.column(1)]
                sets = pa.array([np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for _, h in found], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), sets], ["node", "shingles"])

    here = wanted.withColumnRenamed("text_hash", "h")
    read = texts.hint("merge").join(here, (texts.text_hash == here.h) & texts.doc_id.eqNullSafe(here.least)).select("node", "text")
    return stored(read.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard index of at least `similarity`; only a text that stands in some
    pair is read again."""
    sets = _sets(pairs.selectExpr("explode(array(a, b)) AS node").distinct(), texts, nodes, shingle)

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_py(), np.uint32) for z in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and common >= similarity * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    with_a = pairs.join(sets.selectExpr("node AS a", "shingles AS x").hint("merge"), "a")
    both = with_a.join(sets.selectExpr("node AS b", "shingles AS y").hint("merge"), "b")
    out = stored(both.select("a", "b", "x", "y").mapInArrow(same, "a long, b long"), "alike")
    dropped(sets)
    return out


def _crossing(shared: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of different roots that share a group (node, bucket).

    In the first turn a group of up to SMALL members is paired whole. Each member of a larger one is paired with one of the
    group, drawn by a hash of the turn, so that every turn and every group of a text has another one; these pairs are no
    more than the members."""
    joined = stored(shared.hint("merge").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    drawn = F.max(F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("h"), F.col("node").alias("center"), F.col("root").alias("center_root")))
    open_ = joined.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), drawn.alias("_c")).where("lo <> hi")
    open_ = stored(open_.select("bucket", "n", "_c.center", "_c.center_root"), "open")
    met = joined.hint("merge").join(open_.where(F.col("n") > SMALL), "bucket").where("root <> center_root").selectExpr("least(node, center) AS a", "greatest(node, center) AS b")
    if turn == 0:
        few = joined.hint("merge").join(open_.where(F.col("n") <= SMALL).select("bucket"), "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("all"))
        each = few.select(F.explode("all").alias("x"), "all").select("x", F.explode(F.filter("all", lambda y: (y["node"] > F.col("x.node")) & (y["root"] != F.col("x.root")))).alias("y"))
        met = met.unionAll(each.selectExpr("x.node AS a", "y.node AS b"))
    out = stored(met.distinct(), "crossing")
    dropped(joined, open_)
    return out


def cross_links(sets: list[np.ndarray], roots: np.ndarray, sides: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Places (i, j) of sets of shingle hashes with a Jaccard index of at least `similarity` and different roots: enough of them
    that every such pair is joined, by the roots and by these links. With sides only pairs of different ones are compared.

    A bit for each of B classes of hashes says whether a set has an odd number there. Two sets differ in as many hashes as
    their bits differ, or more; so what the bits tell apart is not alike, and all other pairs are compared whole."""
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    sizes, side = sizes[order], None if sides is None else np.asarray(sides)[order]
    part = np.unique(np.asarray(roots)[order], return_inverse=True)[1]
    apart = (1 - similarity) / (1 + similarity)
    bits = np.maximum(64, 1 << (2 + np.ceil(np.log2(np.maximum(sizes, 1)))).astype(np.int64))  # at least four for each hash
    links = []
    for b in np.unique(bits):
        lo, hi = np.searchsorted(bits, b), np.searchsorted(bits, b, "right")
        end = np.searchsorted(sizes, sizes[hi - 1] / similarity + 1e-6, "right")
        if (part[lo:end] == part[lo]).all():
            continue
        maps = np.stack([np.packbits((np.bincount(sets[k] & np.uint32(b - 1), minlength=b) & 1).astype(np.uint8)) for k in order[lo:end]]).view(np.uint64)
        for x in range(lo, hi):
            to = np.searchsorted(sizes, sizes[x] / similarity + 1e-6, "right")
            other = part[x + 1 : to] != part[x]
            if side is not None:
                other &= side[x + 1 : to] != side[x]
            y = np.flatnonzero(other) + x + 1
            if len(y):
                unlike = np.bitwise_count(maps[y - lo] ^ maps[x - lo]).sum(axis=1, dtype=np.int64)
                for z in y[unlike <= apart * (sizes[x] + sizes[y]) + 1e-6]:
                    if part[z] != part[x]:
                        common = len(np.intersect1d(sets[order[x]], sets[order[z]], assume_unique=True))
                        if common >= similarity * (sizes[x] + sizes[z] - common):
                            links.append((int(order[x]), int(order[z])))
                            part[part == part[z]] = part[x]
    return links


def _apart(shared: DataFrame, roots: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all alike texts of different roots within the groups (node, bucket) of over SMALL members.

    Every pair of a group is covered. A group's members are dealt to blocks of BLOCK_BYTES, and each two blocks, or one
    with itself, meet in one task; a group in few bytes is one block. Only groups that hold different roots are read."""
    joined = stored(shared.hint("merge").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    open_ = joined.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where(f"lo <> hi AND n > {SMALL}")
    members = stored(joined.hint("merge").join(open_.select("bucket"), "bucket").select("bucket", "node", "root"), "open")
    dropped(joined)
    if members.isEmpty():
        return members.selectExpr("node AS a", "root AS b")
    sets = _sets(members.select("node").distinct(), texts, nodes, shingle)
    held = members.hint("merge").join(sets.selectExpr("node", "octet_length(shingles) AS size").hint("merge"), "node")
    parts = stored(held.groupBy("bucket").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("parts")), "parts")
    own = members.hint("merge").join(parts, "bucket").withColumn("own", F.pmod(F.xxhash64("node", "bucket"), "parts").cast("int"))
    dealt = own.hint("merge").join(sets.hint("merge"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "shingles")

    def run(group: pa.Table) -> pa.Table:
        own, node, root = (group.column(k).to_numpy() for k in ("own", "node", "root"))
        found = cross_links([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("shingles")], root, None if group.column("i")[0] == group.column("j")[0] else own, similarity)
        a, b = (np.array([node[x[k]] for x in found], np.int64) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    out = stored(dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct(), "apart")
    dropped(sets, parts, members)
    return out


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and component_id of every row: the smallest doc_id reachable over near copies.

    Texts are linked if their fingerprints differ in at most `distance` bits, as in near_duplicates, or if their shingle sets
    have a Jaccard index of at least `similarity`. A fingerprint of all shingles differs in some ten bits at 0.8, which no
    ball of two bits reaches; so each text also has fingerprints of small samples of its shingles, and texts that share one
    are candidates (at 0.8 two texts share none in 2 of 10,000 cases). Equal word sequences are one text.

    First each group of candidates is compared with its center, the text that shares most samples with others (of a text
    and its copies that is the text itself). Then, in groups that are not yet one component, up to SMALL members are compared
    with each other if their components differ; members of larger groups TURNS times with one that is drawn anew. Such a pair
    is compared by signatures of BINS bytes and, if these allow it, on all shingles of the whole texts. Last, in larger groups
    that are still not one component, all members of different components are compared, by bits that lose no pair and then on
    all shingles; this part grows with the square of what such a group still holds apart. Joins are by sorted merges at every size.

    Null and empty texts are alike. Rows with a null doc_id keep it. Rows come out as often as they go in.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", _text_hash())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                found = list(zip(*(sketches(t.as_py(), shingle) for t in batch.column(2))))
                columns = [pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "text_hash", "node", "fp", "sketches", "signature"])

    made = texts.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, node long, fp long, sketches array<long>, signature binary")
    marked = stored(made, "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    nodes = marked.groupBy("node").agg(first.alias("_f"), F.min("fp").alias("fp"), F.first("sketches").alias("sketches"), F.first("signature").alias("signature"))
    nodes = stored(nodes.select("node", "_f.doc_id", "_f.text_hash", "fp", "sketches", "signature").withColumnRenamed("doc_id", "least"), "nodes")

    # whole fingerprints: nodes of one fingerprint are tied to the least of them, and fingerprints by their balls
    owner = stored(nodes.groupBy("fp").agg(F.min("node").alias("owner")), "owners")
    near = stored(ball_links(owner.select("fp"), distance), "balls")
    links = near.join(owner.selectExpr("fp AS a", "owner AS x"), "a").join(owner.selectExpr("fp AS b", "owner AS y"), "b").selectExpr("x AS a", "y AS b")
    links = links.unionAll(nodes.join(owner, "fp").where("node <> owner").selectExpr("node AS a", "owner AS b"))

    # samples: members of a group are compared with its center
    member = nodes.select("node", F.explode("sketches").alias("bucket"))
    sizes = stored(member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = stored(member.hint("merge").join(sizes, "bucket"), "shared")
    rank = shared.groupBy("node").agg(F.sum("n").alias("rank"))
    central = stored(shared.hint("merge").join(rank, "node").groupBy("bucket").agg(F.max(F.struct("rank", "node"))["node"].alias("center")), "centers")
    asked = shared.select("node", "bucket").hint("merge").join(central, "bucket").where("node <> center").selectExpr("node AS a", "center AS b").distinct()
    allowed = stored(_alike(stored(asked, "asked"), nodes.select("node", "signature"), similarity), "allowed")
    alike = _verified(allowed, texts, nodes, shingle, similarity)
    known = stored(links.unionAll(alike), "links")
    roots = stored(connected_components(known), "roots")

    # members of a group that the center has not tied
    for turn in range(TURNS):
        crossing = _crossing(shared.select("node", "bucket"), roots, turn)
        allowed = stored(_alike(crossing, nodes.select("node", "signature"), similarity), "allowed")
        more = _verified(allowed, texts, nodes, shingle, similarity)
        roots = stored(connected_components(roots.selectExpr("node AS a", "root AS b").unionAll(more)), "roots")
    more = _apart(shared.select("node", "bucket"), roots, texts, nodes, shingle, similarity)
    roots = stored(connected_components(roots.selectExpr("node AS a", "root AS b").unionAll(more)), "roots")

    rooted = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(rooted.join(least, "root").select("node", "component_id"), "classes")
    return marked.select("doc_id", "text_hash", "node").join(classes, "node", "left").select("doc_id", "text_hash", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
