"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at ``DISTANCE`` (4) or fewer differing bits. Cut into three segments, two linked
fingerprints differ by at most one bit in at least one of them. So each segment is indexed once whole and once with
each of its bits as a wildcard: an equality join on these variants meets every linked pair, with the side that has the
bit unset on the left and the side that has it set on the right, and the join's condition verifies the distance. From
``PARTS_FROM`` fingerprints on, a key holds a part of the other two segments as well: cut into five, one of them is equal
for sure, and a bucket stays small however many fingerprints there are.

Texts with equal fingerprints are one class before any of this. Classes that sorted neighbours already chain together
have a label before the full join, which then returns only links between different labels: a dense group of near
copies does not become all its pairs, and no link that connects different labels is lost.

``keep_one`` is the stage of a pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more
are near copies. At that similarity fingerprints differ by some 10 bits of 64 (measured: 4 bits or fewer for none of 259
pairs between 0.80 and 0.85), and deletion variants that reach so far would need several hundred rows a text. So beside
the variants, bands of minima of the same shingle hashes bring classes together: each with the hub of its buckets first,
then those that still differ by the prefixes of their sets (rarest shingles first), and the sets themselves decide.

Nulls: a null text counts as empty; its fingerprint is zero and links like any other. A null id takes part, but never
names a component of which another member has an id. Repeated rows stay. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seglume.llm.components import connected
from seglume.llm.textbytes import buffers, map_texts, mix64
from seglume.storage import stage

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Bits of the segments, from the lowest; with three, DISTANCE of 4 or 5 leaves one segment at one bit or none.
SEGMENTS = (22, 21, 21)
#: So many classes of fingerprints make keys of a segment and a part.
PARTS_FROM = 1 << 25
PARTS = 5
_CHUNK = 1 << 16


@dataclass(frozen=True)
class CopyParams:
    """Near copies as ``keep_one`` takes them. A pair at the threshold misses all bands once in about 450 times
    (0.8 ** 6 = 0.26 for a band, and 1 - 0.26 to the power of 20)."""

    size: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 6
    seed: int = 9
    #: Least share of equal bytes in two sketches (the last byte of each minimum): four deviations below the threshold, so
    #: that a pair at the threshold falls short once in some 50,000 times.
    estimate: float = 0.65


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, repeats included, some at a time; of the whole sequence where it is shorter."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        yield np.array([digest(joined, SEED)], np.uint64)
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    for i in range(0, len(starts), _CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK])], np.uint64)


def majority(parts: list[np.ndarray]) -> int:
    """A bit is set if over half of the hashes have it."""
    votes, n = np.zeros(64, np.int64), 0
    for h in parts:
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is set if over half of the shingles' hashes have it (repeats count)."""
    return majority(list(shingle_hashes(text, size)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = buffers(batch.column(1))
        view = memoryview(raw)
        fp = np.array([fingerprint(bytes(view[a:b])) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""
    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _fingerprints, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, sum(SEGMENTS[:i])).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1))


def variants(nodes: DataFrame, parts: bool = False) -> DataFrame:
    """Adds key and side for each whole segment (side null) and each segment with one wildcard bit (side: the bit); with
    ``parts``, once for each of ``PARTS`` parts of the other segments."""
    total, whole = sum(SEGMENTS), len(SEGMENTS)
    k = F.col("k")
    clear = F.expr("fp & ~shiftleft(1L, k)")
    segment, rest, at = F.lit(None), F.lit(None), 0
    for i, width in enumerate(SEGMENTS):
        own = k.between(at, at + width - 1) | (k == total + i)
        segment = F.when(own, _segment(F.when(k < total, clear).otherwise(F.col("fp")), i)).otherwise(segment)
        # the bits above the segment, then those below it
        above = F.shiftrightunsigned("fp", at + width) if at + width < 64 else F.lit(0).cast("long")
        rest = F.when(own, F.shiftleft(above, at).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << at) - 1)))).otherwise(rest)
        at += width
    out = nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(total + whole - 1))))
    bit = F.expr("shiftrightunsigned(fp, k) & 1L").cast("int")
    out = out.withColumn("key", F.shiftleft(k.cast("long"), max(SEGMENTS)).bitwiseOR(segment)).withColumn("side", F.when(k < total, bit))
    if not parts:
        return out.drop("k")
    width = -(-(total - min(SEGMENTS)) // PARTS)
    out = out.withColumn("rest", rest).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    some = F.expr(f"shiftrightunsigned(rest, part * {width}) & {(1 << width) - 1}L")
    key = F.shiftleft("key", width + 3).bitwiseOR(F.shiftleft(F.col("part").cast("long"), width)).bitwiseOR(some)
    return out.withColumn("key", key).drop("k", "rest", "part")


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def chains(nodes: DataFrame) -> DataFrame:
    """Links of sorted neighbours: fingerprints that agree in 38 bits or more are near each other in one of four
    rotations. Only a first grouping, so what it misses is left to the join; it runs over many small windows."""
    links = None
    for turn in (0, 16, 32, 48):
        turned = F.expr(f"shiftleft(fp, {turn}) | shiftrightunsigned(fp, {64 - turn})") if turn else F.col("fp")
        # the window is the top 26 bits, the order the rest
        w = W.partitionBy(F.shiftrightunsigned("turned", 38)).orderBy("turned")
        one = nodes.select("fp", turned.alias("turned")).select("fp", F.lag("fp").over(w).alias("other")).where(_near("fp", "other"))
        links = one if links is None else links.unionByName(one)
    return links.select(F.col("fp").alias("a"), F.col("other").alias("b"))


def links(labelled: DataFrame, parts: bool = False) -> DataFrame:
    """(a, b): every pair of linked fingerprints whose labels differ, through the variants; a pair may come several
    times. Both sides are sorted: Spark sizes them as the table before the explode, which would pass for small."""
    every = variants(labelled, parts)
    zero = every.where("side is null or side = 0").select("key", F.col("fp").alias("a"), F.col("label").alias("la"), F.col("side").isNull().alias("whole"))
    one = every.where("side is null or side = 1").select("key", F.col("fp").alias("b"), F.col("label").alias("lb"))
    return zero.join(one.hint("merge"), (zero.key == one.key) & (F.col("la") != F.col("lb")) & _near("a", "b") & (~F.col("whole") | (F.col("a") < F.col("b")))).select("a", "b")


def _components(marked: DataFrame) -> DataFrame:
    """(fp, component_id) from (doc_id, fp): the smallest doc_id that links reach, of any type that has an order. What grows
    with the table is joined by sorted partitions, not broadcast through the driver."""
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    first = connected(nodes.select(F.col("fp").alias("node")), chains(nodes), "simhash-chains")
    labelled = nodes.join(first.withColumnRenamed("node", "fp").hint("merge"), "fp")
    labelled = stage(labelled, "simhash-labels")
    # links between the labels of the first grouping, then components of labels
    by = labelled.select("fp", "label")
    found = links(labelled, labelled.count() >= PARTS_FROM)
    pairs = found.join(by.select(F.col("fp").alias("a"), F.col("label").alias("la")).hint("merge"), "a").join(by.select(F.col("fp").alias("b"), F.col("label").alias("lb")).hint("merge"), "b")
    second = connected(by.select(F.col("label").alias("node")).distinct(), pairs.select(F.col("la").alias("a"), F.col("lb").alias("b")), "simhash-links")
    classes = labelled.join(second.select(F.col("node").alias("label"), F.col("label").alias("component")).hint("merge"), "label")
    smallest = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    return stage(classes.select("fp", "component").join(smallest.hint("merge"), "component").select("fp", "component_id"), "simhash-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id that links reach); one row a document."""
    marked = stage(fingerprints(docs, id_col, text_col), "simhash-marks")
    return marked.join(_components(marked).hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by similarity

@cache
def _odd(p: CopyParams) -> np.ndarray:
    return np.random.default_rng(p.seed).integers(0, 1 << 63, p.bands * p.rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, p: CopyParams) -> np.ndarray:
    """Of each of the bands' rows the least hash, each row over all hashes times an odd number; none of an empty text."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    odd, least = _odd(p), np.full(p.bands * p.rows, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[i : i + 1024, None] * odd).min(axis=0))
    return mix64(least)


def band_keys(least: np.ndarray, p: CopyParams) -> list[int]:
    """A key for each band: a hash of its minima."""
    if not len(least):
        return []
    key = np.arange(1, p.bands + 1, dtype=np.uint64)
    for row in least.reshape(p.bands, p.rows).T:
        key = mix64(key + row)
    return key.view(np.int64).tolist()


def _copy_marks(p: CopyParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(1))
            view, rows = memoryview(raw), []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                parts = list(shingle_hashes(bytes(view[a:b]), p.size))
                own = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                fp, least = majority(parts), minima(own, p)
                rows.append((xxhash.xxh3_128_digest(own.astype("<u8").tobytes()), fp - (1 << 64) if fp >> 63 else fp, len(own), band_keys(least, p), least.astype(np.uint8).tobytes()))
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "class", "fp", "n", "bands", "sketch"])

    return run


def _copy_sets(p: CopyParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(1))
            view = memoryview(raw)
            sets = [np.unique(np.concatenate(list(shingle_hashes(bytes(view[a:b]), p.size)))).view(np.int64) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["class", "shingles"])

    return run


#: A class with more partners than this meets them in several tasks.
_PARTNERS = 4096


def _likely(p: CopyParams):
    """The pairs (a, b) whose sketches agree in a share of their bytes that copies do not fall short of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (buffers(batch.column(i))[0].reshape(len(batch), p.bands * p.rows) for i in (2, 3))
            keep = pa.array(np.flatnonzero((x == y).sum(axis=1) >= p.estimate * p.bands * p.rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, p: CopyParams) -> DataFrame:
    """The pairs (a, b) of classes whose sets of shingles are similar; sets are made of one text of each class that is in
    a pair. The sides of a pair meet by the class with many partners in as many tasks as those ask for."""
    pairs = stage(pairs.distinct(), "simhash-candidates")
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    named = nodes.join(wanted, "class", "left_semi").select("class", F.col("key").alias("_key"))
    found = texts.join(named, texts["key"] == named["_key"]).dropDuplicates(["class"]).select("class", "text")
    sets = stage(map_texts(found, _copy_sets(p), "class binary, shingles array<long>"), "simhash-sets")
    fan = pairs.groupBy("a").agg(F.floor(F.count("*") / _PARTNERS).cast("int").alias("most"))
    one = sets.join(fan, sets["class"] == fan["a"]).select("a", F.col("shingles").alias("x"), F.explode(F.sequence(F.lit(0), F.col("most"))).alias("salt"))
    two = pairs.join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("most") + 1).cast("int"))
    two = two.join(sets.withColumnRenamed("shingles", "y"), F.col("b") == F.col("class")).select("a", "b", "salt", "y")
    common = F.size(F.array_intersect("x", "y"))
    return one.join(two, ["a", "salt"]).withColumn("common", common).where(F.col("common") >= p.similarity * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def _sizes_allow(n: str, m: str, p: CopyParams) -> Column:
    return F.least(n, m) >= p.similarity * F.greatest(n, m)


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """class, n, bucket, c (classes in the bucket) of the buckets with two classes or more; one shuffle serves both sides."""
    buckets = nodes.select("class", "n", F.explode("bands").alias("bucket")).repartition("bucket")
    return stage(buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "bucket"), "simhash-shared")


def _first_pairs(nodes: DataFrame, buckets: DataFrame, p: CopyParams) -> DataFrame:
    """Each class with the hub of each of its buckets, and with sorted neighbours: no group becomes its pairs. The hub is
    the class that meets most others: copies with changes of their own are nearer to what they are copies of than to each
    other."""
    degree = buckets.groupBy("class").agg(F.sum("c").alias("degree"))
    met = buckets.join(degree, "class").select("class", "n", "bucket", "degree")
    hubs = met.groupBy("bucket").agg(F.max(F.struct("degree", "class", "n")).alias("hub"))
    stars = buckets.join(hubs, "bucket").where("class <> hub.class").where(_sizes_allow("n", "hub.n", p)).select(F.col("hub.class").alias("a"), F.col("class").alias("b"))
    first = nodes.groupBy("fp").agg(F.min("class").alias("class"))
    same = nodes.join(first.withColumnRenamed("class", "a"), "fp").where("class <> a").select("a", F.col("class").alias("b"))
    near = chains(first).join(first.select(F.col("fp").alias("a"), F.col("class").alias("ca")), "a").join(first.select(F.col("fp").alias("b"), F.col("class").alias("cb")), "b")
    return stars.unionByName(same).unionByName(near.select(F.greatest("ca", "cb").alias("b"), F.least("ca", "cb").alias("a")))


def _prefixes(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, p: CopyParams) -> DataFrame:
    """token, id, class, label, n, at, own for the shingles with which each of the classes ``mixed`` begins when its own
    are sorted by how many of the classes have them: of two sets that are similar enough the first common shingle is in
    the prefix of both, and among the ``own`` rows of the one that is not larger. What a class has alone sorts first, so
    copies with changes of their own too many to be similar have no common row, however many they are."""
    named = nodes.join(mixed, "class", "left_semi").select("class", F.col("key").alias("_key"))
    found = texts.join(named, texts["key"] == named["_key"]).dropDuplicates(["class"]).select("class", "text")
    sets = map_texts(found, _copy_sets(p), "class binary, shingles array<long>").join(mixed, "class").withColumn("id", F.monotonically_increasing_id())
    sets = stage(sets.select("id", "class", "label", F.size("shingles").alias("n"), "shingles"), "simhash-mixed")
    tokens = sets.select("id", F.explode("shingles").alias("token")).repartition("token")
    common = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "token")
    order = common.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("order"))
    out = sets.drop("shingles").join(order, "id").select("id", "class", "label", "n", F.size("order").alias("k"), F.posexplode("order").alias("i", "t"))
    out = out.select(F.col("t.token").alias("token"), "id", "class", "label", "n", (F.col("n") - F.col("k") + F.col("i")).alias("at"))
    first = lambda share: F.col("at") <= F.col("n") - F.ceil(share * F.col("n") - 1e-6)
    return out.where(first(p.similarity)).withColumn("own", first(2 * p.similarity / (1 + p.similarity)))


def _other_pairs(labelled: DataFrame, buckets: DataFrame, nodes: DataFrame, texts: DataFrame, p: CopyParams) -> DataFrame:
    """All pairs of classes with different labels that may be similar, among the classes that share a bucket with another
    label, and those with linked fingerprints. Shared prefixes stand for the buckets here: no such pair is lost, and a
    group that is not similar makes no pairs. Of a prefix's shingle, the classes with its most frequent label stand on one
    side only: a dense group costs nothing but where others are."""
    met = buckets.join(labelled.select("class", "label"), "class")
    several = met.groupBy("bucket").agg(F.min("label").alias("one"), F.max("label").alias("last")).where("one <> last").select("bucket")
    mixed = stage(met.join(several, "bucket", "left_semi").select("class", "label").distinct(), "simhash-met")
    rows = stage(_prefixes(mixed, nodes, texts, p), "simhash-prefixes")
    counts = rows.groupBy("token", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("token", F.col("m.label").alias("main"))
    here = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "class", "label", "n", "at", "own")]
    few = rows.join(main, "token").where("label <> main").select("token", "main", *here("a"))
    every = rows.join(main.select("token"), "token", "left_semi").select("token", *here("b"))
    once = "label_a <> label_b and (label_b = main or id_a < id_b)"
    smaller = F.expr("(own_a and (n_a < n_b or (n_a = n_b and id_a < id_b))) or (own_b and (n_b < n_a or (n_a = n_b and id_b < id_a)))")
    # what is left of both sets from here on bounds what they have in common
    enough = F.expr("least(n_a - at_a, n_b - at_b)") >= p.similarity / (1 + p.similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6
    shared = few.join(every, "token").where(once).where(smaller & enough).where(_sizes_allow("n_a", "n_b", p))
    shared = shared.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))
    by = labelled.select("fp", "label").distinct()
    found = links(by, by.count() >= PARTS_FROM).distinct()
    side = lambda x: labelled.select(F.col("fp").alias(x), F.col("class").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), F.col("label").alias(f"l_{x}"))
    linked = found.join(side("a"), "a").join(side("b"), "b").where("l_a <> l_b").where(_sizes_allow("n_a", "n_b", p)).select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b"))
    return shared.unionByName(linked)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: CopyParams = CopyParams()) -> DataFrame:
    """One row of each group of near copies: the smallest id (null last), of its texts the one with the least digest, of
    equal rows any. Ids may be null or repeated."""
    p = params
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit("")).alias("digest"))
    key = lambda r: F.concat_ws(":", F.coalesce(F.concat(F.lit("s"), r["id"].cast("string")), F.lit("n")), r["digest"])
    texts = docs.select(row.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = stage(map_texts(texts, _copy_marks(p), f"doc_id {dict(texts.dtypes)['doc_id']}, class binary, fp long, n int, bands array<long>, sketch binary"), "simhash-marks")
    nodes = marked.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("fp", "n", "bands", "sketch"), "doc_id").alias("m"))
    nodes = stage(nodes.select("class", "rep", "m.*").withColumn("key", key(F.col("rep"))), "simhash-classes")
    keyed = texts.select(key(F.col("doc_id")).alias("key"), "text")
    buckets = _shared_buckets(nodes)

    first = stage(_alike(_first_pairs(nodes, buckets, p), nodes, keyed, p), "simhash-first")
    labels = connected(nodes.select(F.col("class").alias("node")), first, "simhash-groups")
    labelled = stage(nodes.join(labels.withColumnRenamed("node", "class"), "class").select("class", "rep", "fp", "n", "label"), "simhash-labels")
    more = _alike(_other_pairs(labelled, buckets, nodes, keyed, p), nodes, keyed, p)
    by = labelled.select("class", "label")
    met = more.join(by.select(F.col("class").alias("a"), F.col("label").alias("la")), "a").join(by.select(F.col("class").alias("b"), F.col("label").alias("lb")), "b")
    last = connected(by.select(F.col("label").alias("node")).distinct(), met.select(F.col("la").alias("a"), F.col("lb").alias("b")), "simhash-links")
    smallest = labelled.join(last.withColumnRenamed("label", "component").withColumnRenamed("node", "label"), "label").groupBy("component").agg(F.min("rep").alias("rep"))
    named = stage(smallest.select(key(F.col("rep")).alias("_key")), "simhash-kept")

    # one shuffle serves the window and the join: both are by the key
    order = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key(row).alias("_key"), order.alias("_order"))
    one = rows.join(named, "_key", "left_semi").withColumn("_at", F.row_number().over(W.partitionBy("_key").orderBy("_order"))).where("_at = 1")
    return one.select("_row.*")
