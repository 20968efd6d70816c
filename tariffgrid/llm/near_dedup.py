"""MinHash near-duplicate detection with dart sketches and exact verification."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffgrid.llm.common import drop_stored, durable, prepare, read_table, stored
from tariffgrid.llm.components import connected_components
from tariffgrid.llm.dart_minhash import band_hashes, sketch
from tariffgrid.llm.shingles import jaccard_counts, text_shingles

#: 30 bands of 6 coordinates: a pair at similarity 0.8 meets in a band with probability
#: 1 - (1 - 0.8^6)^30 = 0.9999, one at 0.4 with 0.12.
BANDS, ROWS, SIZE, SIMILARITY = 30, 6, 5, 0.8
#: Rounds in which a node is compared with one pivot only, before the exact rest.
STAR_ROUNDS = 2
#: Shingles of a block of nodes in the exact rest: bounds what one task holds.
BLOCK_SHINGLES = 200_000
_SKETCH_DOCS = 200
_SKETCHES = {"digest": pa.binary(), "size": pa.int64(), "bands": pa.list_(pa.int64())}


def _sketches(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _SKETCH_DOCS):
                part = batch.slice(k, _SKETCH_DOCS)
                texts = part.column(2).to_pylist()
                sets = [text_shingles(t, size) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                hashes = band_hashes(sketch([sets[i] for i in full], bands * rows), bands).tolist() if full else []
                of = dict(zip(full, hashes))
                digests = [hashlib.blake2b(b" ".join(t.lower().encode("utf-8", "surrogatepass").split()), digest_size=16).digest() if len(s) else None for t, s in zip(texts, sets)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([of.get(i) for i in range(len(texts))], pa.list_(pa.int64()))],
                    names=["id", "text_hash", *_SKETCHES],
                )

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("same", pa.bool_())])


def _verified(size: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()  # the last few pivots' shingles

        def pivot(node: int, text: str) -> np.ndarray:
            if node not in kept:
                kept[node] = text_shingles(text, size)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[node]

        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            same = []
            for x, y, s, t in zip(a, b, ta, tb):
                both, either = jaccard_counts(text_shingles(s, size), pivot(y, t))
                same.append(both * denominator >= numerator * either)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(same, pa.bool_())], schema=_PAIRS)

    return run


def _shingles(size: int):
    """(node, shingles cut to 32 bits) of each text: a false match only ever makes a shingle look shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique((text_shingles(t, size) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    return run


def _supported(slots: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """slots with `common`, an upper bound of the shingles a node shares with any other, without nodes that can't be alike to any.

    A node alike to another shares at least `similarity` of its shingles with it. Shingles
    that no other node of these slots has can't be among them; counting those needs one
    aggregation by shingle, and drops the many nodes that share only a passage.
    """
    nodes = slots.select("node").distinct()
    each = texts.join(nodes, "node", "left_semi").mapInArrow(_shingles(size), "node long, shingles array<int>")
    alone = each.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    counted = slots.drop("common").join(own, "node", "left").withColumn("common", F.col("size") - F.coalesce("own", F.lit(0))).drop("own")
    # Shingles that agree in 32 bits are one here and two in size: they only raise the bound.
    return durable(counted.where(F.col("common") >= similarity * F.col("size")))


_LINKS = "a long, b long"


def _full_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [text_shingles(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _compare_blocks(numerator: int, denominator: int):
    """Links between nodes of different components in a pair of blocks, by counting shared shingles in postings."""

    def run(table: pa.Table) -> pa.Table:
        node, comp, block = (np.array(table.column(c).to_pylist(), np.int64) for c in ("node", "comp", "block"))
        sets = [np.asarray(s, np.int64) for s in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], np.repeat(np.arange(len(sets)), sizes)[order]
        across = len(np.unique(block)) > 1
        found_a, found_b = [], []
        for x, own in enumerate(sets):
            if across and block[x] != block.min():
                continue
            first, last = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            lengths = last - first
            at = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            alike = shared * denominator >= numerator * (sizes[x] + sizes - shared)
            other = np.flatnonzero(alike & (comp != comp[x]) & (block != block[x] if across else node > node[x]))
            found_a += [node[x]] * len(other)
            found_b += node[other].tolist()
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return run


def _sharing_rare(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, s) of rare shingles that nodes of different components share; nodes alike have one in common.

    In one order of all shingles, rarest first, two sets that reach the similarity agree in
    one of the first size - ceil(similarity * size) + 1 of each. Of nodes that share no more
    than a template or a passage these are their own, so that they aren't compared.
    """
    each = sets.select("node", F.explode("shingles").alias("s")).join(nodes.select("node", "comp"), "node")
    held = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("n > 1")
    of = each.select("node", "s").join(held, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "s", (F.col("c0") != F.col("c1")).alias("across")))).alias("common"))
    first = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1 - (F.col("size") - F.size("common"))  # shingles of one node come before all others
    rare = of.join(nodes.select("node", "size"), "node").where(first > 0).select("node", F.explode(F.slice("common", F.lit(1), first.cast("int"))).alias("x"))
    return rare.where("x.across").select("node", F.col("x.s").alias("s"))


def _rest(left: DataFrame, texts: DataFrame, size: int, similarity: float, numerator: int, denominator: int) -> DataFrame:
    """The links (a, b), durable, between nodes of left that are still in different components.

    Nodes that hang together by rare shingles are dealt into blocks of a bounded number of
    shingles, and each pair of blocks is one task, which emits only verified links.
    """
    nodes = durable(left.groupBy("node").agg(F.first("comp").alias("comp"), F.first("size").alias("size")))
    sets = stored(texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(_full_shingles(size), "node long, shingles array<long>"))
    rare = durable(_sharing_rare(nodes, sets, similarity))
    hung = connected_components(rare.join(rare.groupBy("s").agg(F.min("node").alias("b")), "s").select(F.col("node").alias("a"), "b"))
    placed = nodes.join(hung.select("node", F.col("comp").alias("g")), "node")
    groups = placed.groupBy("g").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    dealt = placed.join(groups.select("g", "blocks"), "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    sent = dealt.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = sent.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "comp", "block", "shingles")
    links = durable(pair.groupBy("g", "i", "j").applyInArrow(_compare_blocks(numerator, denominator), _LINKS))
    drop_stored(sets)
    return links


def near_duplicate_classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = SIZE, similarity: float = SIMILARITY
) -> DataFrame:
    """One row (id, class_id) for every row of docs; class_id is the least id of its class.

    Texts are alike if the Jaccard similarity of their sets of `size`-word shingles
    (lower-cased, words between ASCII white space) reaches `similarity`; classes are the
    connected components. Every class link is verified on the whole texts.

    1. One pass makes, for each text, a digest of its words and a dart sketch. Rows with
       the same words become one node, so copies are never paired.
    2. Nodes that share a band hash are candidates; each is compared with the least node
       of its buckets, so a bucket of n nodes costs n comparisons, not n squared.
    3. In buckets that still hold several components, nodes that share too few shingles
       with all others together to be alike to any are set aside. For some rounds each of
       the rest is compared with the pivot of a bucket that shares the most.
    4. Nodes of buckets that then still hold several components are compared, in blocks of
       bounded size, with all that share one of their rarest shingles, so that no candidate
       link is lost. That work is quadratic in such a group; it counts shared shingles,
       pairs are not rows.

    Defined results: ids may be of any type that has an order; a null text, or one without
    words, is a class of its own; a text of fewer than `size` words is one shingle; a null
    id gets a null class; rows that repeat an id, also with other texts, count as one
    document and share a class; ties can't be, as classes don't depend on the order of
    comparisons; an empty table gives no rows. Extra columns are ignored. Nothing is
    gathered on the driver but one flag a round. The result is a table in the shared
    folder; the tables it was made from are deleted.
    """
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.select("id", F.xxhash64("text").alias("text_hash"), "text")
    kinds = base.select("id", "text_hash").schema.add("digest", "binary").add("size", "long").add("bands", T.ArrayType(T.LongType()))
    made = stored(base.mapInArrow(_sketches(bands, rows, size), kinds))
    worded = made.where("id is not null and digest is not null")
    first = worded.groupBy("digest").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    firsts = stored(first.select("digest", "first.*", "bands", "size").withColumn("node", F.monotonically_increasing_id()))
    lead = firsts.select("node", "size", F.explode("bands").alias("h"))
    shared = lead.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("h")
    slots = durable(lead.join(shared, "h").distinct())
    wanted = firsts.join(slots.select("node").distinct(), "node", "left_semi").select("id", "text_hash", "node")
    texts = stored(base.join(wanted, ["id", "text_hash"]).groupBy("id", "text_hash", "node").agg(F.first("text").alias("text")).select("node", "text"))

    numerator, denominator = round(similarity * 1_000_000), 1_000_000
    # What two sets share is at most what either shares with any other, and at least s / (1 + s) of both sizes.
    possible = F.least("common", "common_b") * (1.0 + similarity) + 1e-6 >= similarity * (F.col("size") + F.col("size_b"))

    def verify(pairs: DataFrame) -> DataFrame:
        """pairs (a, b): whether they are alike, durable."""
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return durable(both.select("a", "b", "ta", "tb").mapInArrow(_verified(size, numerator, denominator), "a long, b long, same boolean"))

    comps, failed = None, None
    slots = slots.withColumn("common", F.col("size"))

    def placed() -> DataFrame:
        """slots with the component of each node so far."""
        return slots.withColumn("comp", F.col("node")) if comps is None else slots.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def split_slots() -> DataFrame:
        """The placed slots of buckets that hold several components."""
        at = durable(placed())
        return at.join(at.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("h"), "h")

    def link(good: DataFrame) -> DataFrame | None:
        """Components with more verified links."""
        if good.isEmpty():
            return comps
        return durable(connected_components(good if comps is None else good.unionByName(comps.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")))))

    comps = link(_same_id(worded, firsts))
    for turn in range(STAR_ROUNDS):
        at = placed()
        # The first pivot is the least node, later ones are those with the most in common, in another order each turn.
        rank = F.struct(-F.col("node") if turn == 0 else F.col("common") / F.col("size"), F.xxhash64("node", F.lit(turn)), "node", "size", "common", "comp")
        split = at.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max(rank).alias("p")).where("c0 <> c1")
        pivots = split.select("h", *(F.col(f"p.{c}").alias(f"{c}_b") for c in ("node", "size", "common", "comp")))
        near = at.join(pivots, "h").where("comp <> comp_b").where(possible)
        best = F.struct(-F.col("node_b") if turn == 0 else F.col("common_b") / F.col("size_b"), F.xxhash64("node_b", F.lit(turn)), F.col("node_b").alias("b"))
        pairs = near.groupBy(F.col("node").alias("a")).agg(F.max(best).alias("p")).select("a", F.col("p.b").alias("b"))
        if failed is not None:
            known = failed.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
            pairs = pairs.join(known, (F.least("a", "b") == known.x) & (F.greatest("a", "b") == known.y), "left_anti")
        seen = verify(pairs)
        bad = seen.where(~F.col("same")).select("a", "b")
        failed = bad if failed is None else failed.unionByName(bad)
        comps = link(seen.where("same").select("a", "b"))
        if turn == 0:
            slots = _supported(split_slots().drop("comp"), texts, size, similarity)
    comps = link(_rest(durable(split_slots()), texts, size, similarity, numerator, denominator))

    result = stored(_with_classes(made, firsts, comps).select(F.col("id").alias(id_col), "class_id"))
    drop_stored(made, firsts, texts)
    return result


def _same_id(worded: DataFrame, firsts: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of an id that has several texts."""
    several = worded.groupBy("id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 <> d1").select("id")
    nodes = worded.join(several, "id", "left_semi").select(F.col("id").alias("of"), "digest").join(firsts.select("digest", "node"), "digest")
    return nodes.join(nodes.groupBy("of").agg(F.min("node").alias("b")), "of").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _with_classes(made: DataFrame, firsts: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(id, class_id) of every row."""
    named = firsts.select("digest", "node", F.col("id").alias("first"))
    if comps is not None:
        linked = comps.join(named.select("node", "first"), "node")
        classes = linked.join(linked.groupBy("comp").agg(F.min("first").alias("least")), "comp").select("node", "least")
        named = named.join(classes, "node", "left").withColumn("first", F.coalesce("least", "first"))
    named = named.select("digest", F.col("first").alias("class_id"))
    rows = made.select("id", "digest")
    worded = rows.where("id is not null and digest is not null").join(named, "digest").select("id", "class_id")
    blank = rows.where("id is not null and digest is null").select("id")
    beside = worded.join(blank.distinct(), "id", "left_semi").groupBy("id").agg(F.min("class_id").alias("class_id"))  # one class an id
    blank = blank.join(beside, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    unknown = rows.where("id is null").select("id", F.col("id").alias("class_id"))
    return worded.unionByName(blank).unionByName(unknown)


def keep_first_of_class(docs: DataFrame, classes: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id leads its class, one row for an id; rows with a null id stay.

    Of rows that repeat a leading id the one stays whose columns, as JSON, come first, so
    that reruns agree. Extra columns are carried; an empty table gives no rows.
    """
    led = classes.where(F.col(id_col) == F.col("class_id")).groupBy(id_col).count()
    once = docs.join(led.where("count = 1").select(id_col), id_col, "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    many = docs.join(led.where("count > 1").select(id_col), id_col, "left_semi").groupBy(F.col(id_col).alias("one id")).agg(F.min_by(row, F.to_json(row)).alias("one row")).select("`one row`.*")
    return once.unionByName(many).unionByName(docs.where(F.col(id_col).isNull()))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document."""
    return near_duplicate_classes(read_table(spark, sf_dir, "documents"))
