"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every window of `window` words of the benchmark is hashed; the windows of each
document are hashed likewise and probed in the broadcast set, and a probe that finds
its hash is verified word by word. DataFrame functions only.

The windows of all lengths that the benchmark has are hashed and probed in one pass
over the documents. The set grows with the benchmark, so its size is checked: if the
windows take more than `block_bytes`, only their hashes are broadcast, in blocks of
that size (usually still one), and what they find, a small part of the documents'
windows, is kept and verified against blocks of the windows themselves.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable, let, named, without

#: What separates words once A to Z are lower case: ASCII that is neither digit nor letter.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Runs of word characters and of others in a text as it is.
RUNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def window_hashes(words: Column, *lens: int) -> Column:
    """For each n of lens in turn, a hash of each window of n words by position; none if there are fewer words.

    Hashes of windows of 1, 2, 4, ... words are each made of two of the size before,
    and n is a sum of such sizes, so that a window takes a few steps and not n.
    """

    def joined(a: Column, b: Column, step: int) -> Column:
        return F.transform(a, lambda x, i: F.xxhash64(x, F.get(b, i + step)))

    def of(n: int, made: dict[int, Column]) -> Column:
        sizes = [k for k in sorted(made, reverse=True) if n & k]
        out, done = made[sizes[0]], sizes[0]
        for k in sizes[1:]:
            out, done = joined(out, made[k], done), done + k
        return F.when(F.size(words) >= n, F.slice(out, 1, F.size(words) - (n - 1))).otherwise(F.array().cast("array<bigint>"))

    def build(made: dict[int, Column]) -> Column:
        top = max(made)
        if 2 * top <= max(lens):
            return let(joined(made[top], made[top], top), lambda x: build({**made, 2 * top: x}))
        each = [of(n, made) for n in lens]
        return F.concat(*each) if len(each) > 1 else each[0]

    return F.when(F.size(words) >= min(lens), let(F.transform(words, lambda x: F.xxhash64(x)), lambda x: build({1: x}))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(n, h, gram, item_ids): distinct windows; an item of fewer words, but not none, is one window."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    grams = items.select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))).alias("gram"))
    h = F.coalesce(*[F.when(F.col("n") == k, F.get(window_hashes(F.col("gram"), k), F.lit(0))) for k in range(1, window + 1)])
    return grams.groupBy("n", "gram").agg(F.collect_set("item_id").alias("item_ids")).select("n", h.alias("h"), "gram", "item_ids")


#: Bytes that a hash takes in a broadcast table.
HASH_BYTES = 32


def probed(docs: DataFrame, windows: DataFrame, keys: list[str], text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """(*keys, n_words, pos, n, item_ids): the windows found, pos counting words from
    0, and for each row of docs one row more, which has a null pos."""
    size = windows.groupBy("n").agg(F.count("*").alias("rows"), F.sum(F.length(F.concat_ws(" ", "gram")) + 64 + 16 * F.col("n") + 16 * F.size("item_ids")).alias("bytes")).collect()  # a row for each length
    lens = sorted((r.n for r in size), reverse=True)
    words = docs.select(*keys, words_of(F.col(text_col)).alias("words"))
    n_words = F.size("words").cast("long").alias("n_words")
    if not lens:
        kind = windows.schema["item_ids"].dataType.simpleString()
        return words.select(*keys, n_words, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("n"), F.lit(None).cast(kind).alias("item_ids"))
    blocks = ceil(sum(r.bytes for r in size) / block_bytes)
    block = lambda of, k: windows.filter(F.pmod("h", F.lit(of)) == k)

    # A place in the row of all hashes gives the window's length and position.
    n, pos, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for x in lens:
        here = F.greatest(F.size("words") - (x - 1), F.lit(0))
        n = F.coalesce(n, F.when(F.col("at") < before + here, F.lit(x)))
        pos = F.coalesce(pos, F.when(F.col("at") < before + here, F.col("at") - before))
        before = before + here

    def places(last: bool) -> DataFrame:
        """All windows of all rows by hash; with last, a null hash at the end stands for the row."""
        end = F.array(F.lit(None).cast("bigint")) if last else F.array().cast("array<bigint>")
        hashed = words.select(*keys, "words", F.concat(let(F.col("words"), lambda w: window_hashes(w, *lens)), end).alias("hs"))
        return hashed.select(*keys, "words", F.posexplode("hs").alias("at", "h"))

    if blocks == 1:
        sent = windows.select("h", F.col("n").alias("n of"), "gram", "item_ids")
        probe = places(True).join(F.broadcast(sent), "h", "left").filter(F.col("h").isNull() | F.col("n of").isNotNull())
        at = probe.select(*keys, n_words, "words", "h", F.when(F.col("h").isNotNull(), pos).alias("pos"), F.when(F.col("h").isNotNull(), n).alias("n"), "n of", "gram", "item_ids")
        same = (F.col("n") == F.col("n of")) & (F.slice("words", F.col("pos") + 1, F.col("n")) == F.col("gram"))
        return at.filter(F.col("h").isNull() | same).select(*keys, "n_words", "pos", "n", "item_ids")
    passes, found = ceil(sum(r.rows for r in size) * HASH_BYTES / block_bytes), None
    for k in range(passes):
        sent = block(passes, k).select("h").distinct().withColumn("known", F.lit(True))
        probe = places(k == 0).join(F.broadcast(sent), "h", "left").filter(F.col("h").isNull() | F.col("known"))
        at = probe.select(*keys, n_words, "h", F.when(F.col("h").isNotNull(), pos).alias("pos"), F.when(F.col("h").isNotNull(), n).alias("n"), "words")
        at = at.withColumn("words", F.when(F.col("pos").isNotNull(), F.slice("words", F.coalesce("pos", F.lit(0)) + 1, F.coalesce("n", F.lit(0)))))
        found = at if found is None else found.union(at)
    found = durable(found)
    out = found.filter(F.col("pos").isNull()).select(*keys, "n_words", "pos", "n", F.lit(None).cast(windows.schema["item_ids"].dataType).alias("item_ids"))
    for k in range(blocks):
        sent = block(blocks, k).select("h", "n", F.col("gram").alias("words"), "item_ids")
        out = out.union(found.join(F.broadcast(sent), ["h", "n", "words"]).select(*keys, "n_words", "pos", "n", "item_ids"))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_hit (words inside any occurrence
    of a window), n_items, items_sha256, contaminated, and spans, an array of
    (first, past) word positions of the hit runs.

    A null text has no words. Rows are told apart by id and text, so rows repeated in
    both share their result and each comes back; null ids are matched as equal. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_h"))
    windows = durable(benchmark_windows(benchmark, window))
    found = probed(rows, windows, ["id", "text_h"], block_bytes=block_bytes).groupBy("id", "text_h").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(F.col("pos").isNull(), 1)).alias("copies"),
        F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "n"))).alias("at"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("items"),
    )
    covered = F.sort_array(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["n"] - 1)))))
    marked = found.select(F.explode(F.array_repeat(F.struct("id", "n_words", covered.alias("c"), F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("items")), F.col("copies").cast("int"))).alias("r")).select("r.*")
    first = F.filter("c", lambda x, i: (i == 0) | (F.get("c", i - 1) != x - 1))
    last = F.filter("c", lambda x, i: (i == F.size("c") - 1) | (F.get("c", i + 1) != x + 1))
    return marked.select(
        F.col("id").alias(id_col), "n_words", F.size("c").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("c") > 0).alias("contaminated"),
        F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b + 1).alias("past"))).alias("spans"),
    )


def without_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, as they are. Null texts have none and stay."""
    rows, names = named(docs, id_col, text_col)
    asked = rows.select(*[F.col(c).alias(f"name{i}") for i, c in enumerate(names)], F.col(text_col).alias("text"))
    found = probed(asked, durable(benchmark_windows(benchmark, window)), ["name0", "name1"], block_bytes=block_bytes).filter(F.col("pos").isNotNull())
    hit = durable(found.groupBy(F.col("name0").alias(names[0]), F.col("name1").alias(names[1])).agg(F.count("*").alias("times")))
    return without(rows, hit, names, "times").select(*docs.columns)


def without_spans(text: Column, spans: Column) -> Column:
    """text less the words of spans, (first, past) by word, and what stands between words of one span."""
    runs = F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))
    lead = F.when(text.rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
    inside = lambda i, s: (i >= 2 * s["first"] + lead) & (i <= 2 * (s["past"] - 1) + lead)
    return F.array_join(F.filter(runs, lambda x, i: ~F.exists(spans, lambda s: inside(i, s))), "")
