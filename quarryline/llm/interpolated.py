"""Language-model scores by deleted interpolation of word bigrams.

P(w | u) = a * c(u w) / c(u) + b * c(w) / N + (1 - a - b) / (V + 1), where the weights
depend on the bucket of c(u), the context's frequency by powers of two. They are
learned by expectation-maximisation on held-out counts: each training token is taken
out of the counts in its turn, and what is left must predict it.

Texts are packed once to batches of some megabytes, in a table in the shared folder,
so that what is a batch does not change when executors come and go. Some batches of
one task make a run. A run asks for the distinct words and bigrams of each of its
batches: sorted hashes, as differences, with the number of times that the batch's
training texts have them. One exchange deals these lists by hash to parts, a list for
each run and part, so that what a list costs besides its entries is shared by the run's
batches; a part adds the counts up, which makes the corpus's table, and answers every
list in its order. The answers go back to the runs, whose texts stay where they are:
the table is bucketed by run. So no table of counts is broadcast or collected, a
frequent word is one entry of a batch as any other is, and the lists are a few bytes
for each entry.
"""

from __future__ import annotations

import struct
import uuid
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, shared_folder, slices, trim

BATCH_BYTES, RUN_BATCHES = 6 << 20, 8
WORD, PAIR, SUMS = 0, 1, -1
#: What stands for the end of a text and the start of one; no word has a space in it.
END, START = np.uint64(xxhash.xxh64_intdigest(b"\n")), np.uint64(xxhash.xxh64_intdigest(b" "))
BUCKETS = 48


def _packed(raw: bytes) -> bytes:
    return struct.pack("<q", len(raw)) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpacked(data: bytes) -> bytes:
    (n,) = struct.unpack("<q", data[:8])
    return pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""


def pack_counts(counts: np.ndarray) -> bytes:
    """Non-negative numbers; bytes of equal weight stand together, so that small numbers take little."""
    return _packed(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_unpacked(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _narrow(numbers: np.ndarray) -> tuple[int, bytes]:
    """Numbers in as few bytes each as the largest needs."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return width, np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, offset: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, offset).reshape(n, width)
    return out.view("<u8").ravel().astype(np.uint64)


def _before(values: np.ndarray, sizes: np.ndarray, first) -> np.ndarray:
    """For each value the one before it; for the first of each segment, `first`."""
    out = np.roll(values, 1)
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = first
    return out


def pack_keys(segments: list[np.ndarray], base: int) -> bytes:
    """Segments of sorted hashes, none below base, as differences."""
    sizes = np.array([len(x) for x in segments], np.int64)
    keys = np.concatenate(segments)
    width, steps = _narrow(keys - _before(keys, sizes, np.uint64(base)))
    wide, lengths = _narrow(sizes)
    return struct.pack("<QBBH", base, width, wide, len(sizes)) + lengths + steps


def unpack_keys(data: bytes) -> np.ndarray:
    """The hashes of all segments, one after the other."""
    base, width, wide, segments = struct.unpack("<QBBH", data[:12])
    sizes = _wide(data, 12, segments, wide).astype(np.int64)
    steps = _wide(data, 12 + segments * wide, int(sizes.sum()), width)
    sums = np.cumsum(steps, dtype=np.uint64)
    past = np.append(np.uint64(0), sums)[np.cumsum(sizes) - sizes]  # before each segment
    return sums - np.repeat(past, sizes) + np.uint64(base)


class Batch:
    """The tokens of some texts and the distinct words and bigrams among them."""

    def __init__(self, texts: pa.Array):
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = words.flatten()
        full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(words.offsets.to_numpy()))[full]
        code = flat.filter(pa.array(full)).dictionary_encode()
        del words, flat, full
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in code.dictionary.cast(pa.binary()).to_pylist()] + [int(END)], np.uint64)
        self.words, rank = np.unique(hashes, return_inverse=True)
        n = np.bincount(of, minlength=len(texts))
        del of
        self.lengths = n + 1  # with the end
        self.starts = np.cumsum(self.lengths) - self.lengths
        place = np.ones(self.lengths.sum(), bool)
        ends = self.starts + n
        place[ends] = False
        self.word = np.empty(len(place), np.int32)  # of each token, its place in self.words
        self.word[place] = rank[code.indices.to_numpy()]
        self.word[ends] = rank[-1]
        self.end = int(rank[-1])
        del code, place
        x = np.roll(self.words[self.word], 1)  # the word before
        x[self.starts] = START
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x += self.words[self.word]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        self.pairs, pair = np.unique(x, return_inverse=True)
        self.pair = pair.astype(np.int32)

    @property
    def context(self) -> np.ndarray:
        """The place of the word before each token. c(start) = c(end), so a first token's is the end's."""
        out = np.roll(self.word, 1)
        out[self.starts] = self.end
        return out

    def counted(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Times that the training texts have each word, and each bigram."""
        own = np.repeat(train, self.lengths)
        return np.bincount(self.word[own], minlength=len(self.words)), np.bincount(self.pair[own], minlength=len(self.pairs))

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(values) else np.zeros(0)


def _packs(batch_bytes: int, run_batches: int):
    """The rows of about batch_bytes of text each, compressed, and run_batches of these a run."""

    def run(batches):
        first, made, rows, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def pack():
            table, sink = pa.Table.from_batches(rows), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
                w.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([first + made // run_batches]), pa.array([made % run_batches], pa.int32()), pa.array([size]), pa.array([sink.getvalue().to_pybytes()])], names=["run", "nth", "bytes", "data"])

        for b in slices(batches, 1, min(batch_bytes, 1 << 20)):
            rows.append(b)
            size += b.column(1).nbytes
            if size >= batch_bytes:
                yield pack()
                made, rows, size = made + 1, [], 0
        if rows:
            yield pack()

    return run


def packed(rows: DataFrame, batch_bytes: int = BATCH_BYTES, run_batches: int = RUN_BATCHES) -> DataFrame:
    """(run, nth, bytes, data): the batches, in a table of the shared folder that is bucketed by run."""
    spark, name = rows.sparkSession, f"packs_{uuid.uuid4().hex}"
    buckets = min(50_000, max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = rows.mapInArrow(_packs(batch_bytes, run_batches), "run long, nth int, bytes long, data binary").write.format("parquet").option("compression", "none").option("parquet.enable.dictionary", "false")
    out.bucketBy(buckets, "run").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved: the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return found


def _opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _texts(table: pa.Table) -> pa.Array:
    return table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string())


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins among sorted keys, and their end."""
    if parts == 1:
        return np.array([0, len(keys)])
    shift = np.uint64(64 - int(log2(parts)))
    return np.append(np.searchsorted(keys, np.arange(parts, dtype=np.uint64) << shift), len(keys))


def _lists(parts: int):
    """For each run and part, the keys of its batches and their counts."""

    def run(packs: pd.DataFrame) -> pd.DataFrame:
        found = {WORD: [], PAIR: []}
        for data in packs.sort_values("nth")["data"]:
            table = _opened(data)
            batch = Batch(_texts(table))
            train = ~table.column("held").to_numpy()
            trim()
            for kind, keys, counts in zip((WORD, PAIR), (batch.words, batch.pairs), batch.counted(train), strict=True):
                found[kind].append((keys, counts.astype(np.uint32), _cuts(keys, parts)))
        rows = []
        for kind, own in found.items():
            sizes = sum(np.diff(cuts) for _, _, cuts in own)
            for p in np.nonzero(sizes)[0].tolist():
                keys = pack_keys([k[cuts[p] : cuts[p + 1]] for k, _, cuts in own], (p << 64) // parts)
                rows.append((int(packs["run"].iloc[0]), kind, p, keys, pack_counts(np.concatenate([c[cuts[p] : cuts[p + 1]] for _, c, cuts in own]))))
        return pd.DataFrame(rows, columns=["run", "kind", "part", "keys", "counts"])

    return run


def _totals(keys: np.ndarray, counts: np.ndarray, turns: int = 4) -> tuple[np.ndarray, int]:
    """For each key the sum of its counts, and how many keys have one. A quarter of the keys is sorted at a time, for memory."""
    out, distinct = np.empty(len(keys), np.int64), 0
    turn = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(61)).astype(np.uint8) % turns
    for t in range(turns):
        at = np.nonzero(turn == t)[0]
        known, place = np.unique(keys[at], return_inverse=True)
        total = np.bincount(place, counts[at], len(known)).astype(np.int64)  # exact below 2 ** 53
        out[at] = total[place]
        distinct += int((total > 0).sum())
    return out, distinct


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """The corpus's counts of a part's keys, list by list; and a row of its sums."""
    keys = [unpack_keys(x) for x in pdf["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    counts = np.concatenate([unpack_counts(x).astype(np.uint32) for x in pdf["counts"]])
    total, distinct = _totals(np.concatenate(keys), counts)
    kind, part = int(pdf["kind"].iloc[0]), int(pdf["part"].iloc[0])
    del keys
    trim()
    rows = [(r, kind, part, pack_counts(x), 0, 0) for r, x in zip(pdf["run"], np.split(total, ends[:-1]), strict=True)]
    return pd.DataFrame([*rows, (SUMS, kind, part, b"", distinct, int(counts.sum(dtype=np.int64)))], columns=["run", "kind", "part", "data", "distinct", "tokens"])


def _met(packs: pd.DataFrame, answers: pd.DataFrame, parts: int):
    """For each batch of a run its table, tokens and the counts of its words and bigrams."""
    flat, at = {}, {}
    for kind in (WORD, PAIR):
        own = answers[answers["kind"] == kind].sort_values("part")
        counts = [unpack_counts(x) for x in own["data"]]
        flat[kind], at[kind] = np.concatenate(counts), np.zeros(parts, np.int64)
        sizes = np.array([len(x) for x in counts])
        at[kind][own["part"].to_numpy()] = np.cumsum(sizes) - sizes

    def take(kind: int, keys: np.ndarray) -> np.ndarray:
        n = np.diff(_cuts(keys, parts))
        index = np.arange(len(keys)) + np.repeat(at[kind] - (np.cumsum(n) - n), n)
        at[kind] += n  # the next batch's keys of a part follow
        return flat[kind][index]

    for data in packs.sort_values("nth")["data"]:
        table = _opened(data)
        batch = Batch(_texts(table))
        yield table, batch, take(WORD, batch.words), take(PAIR, batch.pairs)
        del table, batch
        trim()


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)  # 0, 1, 2-3, 4-7, ...


def _level(p: np.ndarray) -> np.ndarray:
    """Quarter octaves of a probability, 0 for none."""
    return np.where(p > 0, np.clip(np.ceil(-4 * np.log2(np.where(p > 0, p, 1.0))) + 1, 1, 255), 0).astype(np.int64)


def _held_out(tokens: int, parts: int):
    """Counts of a run's training tokens by bucket and by levels of both estimates, each with its own token taken out."""

    def run(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for table, batch, words, pairs in _met(packs, answers, parts):
            own = np.repeat(~table.column("held").to_numpy(), batch.lengths)
            u, w, uw = words[batch.context[own]] - 1, words[batch.word[own]] - 1, pairs[batch.pair[own]] - 1
            p2, p1 = np.where(u > 0, uw / np.maximum(u, 1), 0.0), w / max(1, tokens - 1)
            cell = (bucket(u) * 256 + _level(p2)) * 256 + _level(p1)
            known, at = np.unique(cell, return_inverse=True)
            out.append(pd.DataFrame({"cell": known, "n": np.bincount(at, minlength=len(known)), "p2": np.bincount(at, p2, len(known)), "p1": np.bincount(at, p1, len(known))}))
        return pd.concat(out)

    return run


def learn_weights(cells: list[tuple[int, int, float, float]], types: int, rounds: int = 60, least: int = 50) -> np.ndarray:
    """Weights of bigram, word and uniform estimate for each bucket, by expectation-maximisation.

    cells: (bucket and levels, tokens, sums of both estimates over them). Buckets of
    fewer than `least` tokens take the weights of all buckets together.
    """
    out = np.zeros((BUCKETS, 3))
    data = np.array([(c >> 16, n, p2 / n, p1 / n) for c, n, p2, p1 in cells], np.float64).reshape(-1, 4)

    def fit(rows: np.ndarray) -> np.ndarray:
        weights = np.array([0.4, 0.4, 0.2])
        p = np.column_stack([rows[:, 2], rows[:, 3], np.full(len(rows), 1.0 / (types + 1))])
        for _ in range(rounds):
            share = p * weights
            share *= (rows[:, 1] / share.sum(1))[:, None]
            weights = share.sum(0) / rows[:, 1].sum()
        return weights

    pooled = fit(data) if len(data) else np.array([0.0, 0.0, 1.0])
    for b in range(BUCKETS):
        rows = data[data[:, 0] == b]
        out[b] = fit(rows) if rows[:, 1].sum() >= least else pooled
    out[0, 0] = 0.0  # no context, no bigram estimate
    out[:, 2] = np.maximum(out[:, 2], 1e-9)  # an unknown word stays possible
    return out / out.sum(1, keepdims=True)


def _scores(weights: np.ndarray, tokens: int, types: int, parts: int):
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for table, batch, words, pairs in _met(packs.to_pandas(), answers.to_pandas(), parts):
            u, w, uw = words[batch.context], words[batch.word], pairs[batch.pair]
            mix = weights[bucket(u)]
            p = mix[:, 0] * (uw / np.maximum(u, 1)) + mix[:, 1] * (w / max(1, tokens)) + mix[:, 2] / (types + 1)
            base = np.log10((words + 0.5) / (tokens + 0.5 * (types + 1)))
            out.append(pa.table({
                "id": table.column("id"), "held_out": table.column("held"), "n_tokens": batch.lengths, "n_known": batch.total((w > 0).astype(np.int64)),
                "train_tokens": np.full(table.num_rows, tokens), "base_score": batch.total(base[batch.word]), "score": batch.total(np.log10(p)),
            }))
        return pa.concat_tables(out)

    return run


def parts_for(text_bytes: int, part_bytes: int = 16 << 20) -> int:
    """A power of two that grows with the corpus: the lists of part_bytes of text go to
    a part, and take a few times that in the memory of the worker that adds them up."""
    return 1 << max(0, ceil(log2(max(1.0, text_bytes / part_bytes))))


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, batch_bytes: int = BATCH_BYTES, run_batches: int = RUN_BATCHES) -> DataFrame:
    """A row for each row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where `held` is true teach nothing. A null or blank text is one token, its
    end. Repeated rows each count and each come back. If all rows are held out, N and V
    are zero and every token has the probability 1. Other columns are ignored. parts
    must be a power of two.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    packs = packed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held")), batch_bytes, run_batches)
    parts = parts or parts_for(packs.agg(F.sum("bytes")).first()[0] or 0)
    lists = packs.groupBy("run").applyInPandas(_lists(parts), "run long, kind int, part int, keys binary, counts binary")
    dealt = lists.repartition(min(20_000, 2 * parts), "kind", "part")  # tasks follow the text as parts do
    answers = durable(dealt.groupBy("kind", "part").applyInPandas(_answers, "run long, kind int, part int, data binary, distinct long, tokens long"))
    sums = answers.filter((F.col("run") == SUMS) & (F.col("kind") == WORD)).agg(F.sum("distinct"), F.sum("tokens")).first()
    types, tokens = int(sums[0] or 0), int(sums[1] or 0)

    def met():
        return packs.groupBy("run").cogroup(answers.filter(F.col("run") != SUMS).select(F.col("run").alias("of"), "kind", "part", "data").groupBy("of"))

    cells = met().applyInPandas(_held_out(tokens, parts), "cell long, n long, p2 double, p1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))
    weights = learn_weights([(r.cell, r.n, r.p2, r.p1) for r in cells.orderBy("cell").collect()], types)  # BUCKETS x 256 x 256 cells at most
    out = met().applyInArrow(_scores(weights, tokens, types, parts), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
