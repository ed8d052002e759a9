"""SimHash near-duplicates through an inverted index of positional bytes.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most
two bits differ in at most two bytes, so they share at least six of the eight; that
is the guaranteed minimum of the count filter. Lists of one positional byte over all
fingerprints would hold 1/256 of them, and tallying them would take time with the
square of the corpus. So the index is kept in sections. A section is keyed by four of
the bytes at once: the bytes form four pairs, two differing bytes leave at least two
pairs whole, and the six choices of two pairs put every pair of fingerprints that the
filter can keep into one section at least. Within a section each fingerprint is listed
under each of its other four positional bytes; a pair is tallied once for each list it
meets in, and its tally plus the section's four bytes is the number of positional bytes
it shares. Pairs that reach the minimum are kept, and their bits are compared last.

Sections of many fingerprints (large groups of near copies) are not expanded into
pairs. In them every fingerprint also posts the values one bit away from the bytes
that the section leaves open; fingerprints that meet in such a value differ in two bits
at most, and any that do so meet in one. A value is reached by 33 fingerprints at
most, and each of them is linked to the least, or for one bit to the one that has
the value itself. That is exact and linear.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_NAMES, durable, join_hot, named, slices, without

#: Byte positions that make one posting: two pairs of the four.
PAIRS = ((0, 1), (2, 3), (4, 5), (6, 7))
POSTINGS = tuple(tuple(sorted(a + b)) for a, b in combinations(PAIRS, 2))
BYTES, BLOCK = 8, 65_536


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, ASCII spaces split
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    width = min(shingle, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    begins, ends = start[:n].tolist(), (start + size)[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):  # so that a very long text takes little memory
        h = np.array([digest(joined[a:b], seed) for a, b in zip(begins[i : i + BLOCK], ends[i : i + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, text_h, fp): a hash of the text and its fingerprint as a signed long. A null text has no words and the fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for b in slices(batches, 2):
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "text_h", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_h"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, text_h long, fp long")


def byte_at(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255).cast("long"))


def joined_bytes(fp: Column, positions) -> Column:
    out = F.lit(0).cast("long")
    for k, i in enumerate(positions):
        out = out.bitwiseOR(F.shiftleft(byte_at(fp, i), 8 * k))
    return out


#: Of each section, the positions that it leaves open.
OPEN = tuple(tuple(i for i in range(BYTES) if i not in p) for p in POSTINGS)


def links(nodes: DataFrame, max_bits: int = 2, long_list: int = 48) -> DataFrame:
    """(a, b) with a < b: links between the distinct fingerprints `fp` of nodes.

    Every pair at max_bits (at most two) or less is joined by these links, directly
    or, in sections of more than long_list fingerprints, through a member of the
    values that they share; and no link is longer than max_bits.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("four pairs of bytes guarantee at most two differing bits")
    posts = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("k"), joined_bytes(F.col("fp"), p).alias("v")) for k, p in enumerate(POSTINGS)])).alias("p")).select("fp", "p.k", "p.v")
    sizes = posts.groupBy("k", "v").agg(F.count("*").alias("n")).filter("n > 1")
    shared = durable(posts.join(sizes, ["k", "v"]))

    opened = F.element_at(F.array(*[F.array(*[byte_at(F.col("fp"), i) for i in p]) for p in OPEN]), F.col("k").cast("int") + 1)
    lists = shared.filter(F.col("n") <= long_list).select("k", "v", "fp", F.posexplode(opened).alias("at", "byte"))
    by = ["k", "v", "at", "byte"]
    met = lists.withColumnRenamed("fp", "a").join(lists.withColumnRenamed("fp", "b"), by).filter(F.col("a") < F.col("b"))
    tally = met.groupBy("k", "a", "b").agg(F.count("*").alias("shared"))
    counted = tally.filter(F.col("shared") + (BYTES - len(OPEN[0])) >= BYTES - max_bits).select("a", "b").distinct()
    pairs = counted.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)

    rest = F.element_at(F.array(*[joined_bytes(F.col("fp"), p) for p in OPEN]), F.col("k").cast("int") + 1)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << j).cast("long") for j in range(32 if max_bits else 0)])
    posted = shared.filter(F.col("n") > long_list).select("k", "v", "fp", rest.alias("rest"))
    values = posted.select("k", "v", "fp", "rest", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("rest")))).alias("value"))
    middle = F.min("fp") if max_bits == 2 else F.min(F.when(F.col("rest") == F.col("value"), F.col("fp")))
    sets = values.groupBy("k", "v", "value").agg(F.collect_set("fp").alias("fps"), middle.alias("middle"))  # 33 at most
    stars = sets.filter((F.size("fps") > 1) & F.col("middle").isNotNull()).select("middle", F.explode("fps").alias("fp")).filter("middle <> fp")
    return pairs.union(stars.select(F.least("middle", "fp").alias("a"), F.greatest("middle", "fp").alias("b"))).distinct()


def _followed(labels: DataFrame) -> DataFrame:
    """labels (node, root), durable, with each root's own root in its place. Roots that many nodes share are broadcast."""
    shares = labels.groupBy("root").agg(F.count("*").alias("rows"))
    own = durable(labels.select(F.col("node").alias("root"), F.col("root").alias("next")).join(shares, "root"))
    return join_hot(labels, own, "root", "rows", hot_rows=64).select("node", F.least("root", "next").alias("root"))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node reachable.

    Each round takes the least label among neighbours, tells it to the old label as
    well, and follows labels once, so that distances halve; rounds end when no label
    changes. Labels are kept in the checkpoint folder between rounds.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"))
        best = labels.select("node", F.col("root").alias("old")).join(seen, "node").select("node", "old", F.least("old", "root").alias("root"))
        told = best.groupBy(F.col("old").alias("node")).agg(F.min("root").alias("root"))
        merged = durable(best.select("node", "root").union(told).groupBy("node").agg(F.min("root").alias("root")))
        if merged.join(labels.withColumnRenamed("root", "was"), "node").filter("root <> was").isEmpty():
            return labels
        labels = durable(_followed(merged))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, text_h, fp, root, component_id) for every row of docs; root is the least fingerprint of the row's component."""
    fps = durable(fingerprints(docs, id_col, text_col, shingle))
    nodes = durable(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("rows")))
    roots = components(links(nodes.select("fp"), max_bits)).select(F.col("node").alias("fp"), "root")
    linked = durable(nodes.join(roots, "fp", "left").select("fp", "rep", "rows", F.coalesce("root", "fp").alias("root")))
    least = durable(linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("fps")))
    known = durable(join_hot(linked.select("fp", "rows", "root"), least, "root", "fps", hot_rows=64))
    return join_hot(fps, known, "fp", "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(id_col, fp, component_id) for every row of docs, fp as a signed long.

    component_id is the least id in the row's connected component of fingerprints
    that differ in max_bits bits or less. Null ids count for no minimum; where a
    component has no other, component_id is null. Null, empty and blank texts have
    the fingerprint zero and are linked like any other. Repeated rows each come back.
    Other columns of docs are ignored.
    """
    return classes(docs, id_col, text_col, shingle, max_bits).select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, most: int = BROADCAST_NAMES) -> DataFrame:
    """docs with one row of each component: that of the least id, ids before null, and
    of rows under one id the least by a hash of the text; of equal rows one stays.

    What goes is chosen by names of rows. Rows leave where they are read (common.without);
    only a row that stays and is repeated in id and text is exchanged, to become one.
    """
    rows, names = named(docs, id_col, text_col)
    found = durable(classes(docs, id_col, text_col, shingle, max_bits).select("root", "id", "text_h"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_h")).alias("k"))
    keep = first.select(F.xxhash64("k.id", "k.text_h").alias(names[0]), F.col("k.text_h").alias(names[1]), F.lit(True).alias("stays"))
    each = found.groupBy(F.xxhash64("id", "text_h").alias(names[0]), F.col("text_h").alias(names[1])).agg(F.count("*").alias("n"))
    apart = durable(each.join(keep, names, "left").filter("stays IS NULL OR n > 1"))
    repeated = apart.filter("stays")
    out = without(rows, apart, names, "n", most)
    n = repeated.count()
    if n:
        again = rows.join(F.broadcast(repeated.select(*names)) if n <= most else repeated.select(*names), names, "left_semi")
        out = out.union(again.dropDuplicates(names))
    return out.select(*docs.columns)
