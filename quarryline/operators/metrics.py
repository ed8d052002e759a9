"""Ground truth, recall, answer accuracy and retrieval metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import rounded
from ..functions.text import col, consensus_answer, consensus_punctuation, consensus_words, let, normalize_answer, normalize_title, url_to_title
from .search import sent_blocks


def truth_titles(titles: Column, urls: Column) -> Column:
    """Normalised titles of both `|` lists, titles first, without blanks and repeats; null if there is none."""
    listed = F.transform(F.split(F.coalesce(titles, F.lit("")), r"\|"), normalize_title)
    linked = F.transform(F.split(F.coalesce(urls, F.lit("")), r"\|"), url_to_title)
    return let(F.array_distinct(F.filter(F.concat(listed, linked), lambda t: t != "")), lambda t: F.when(F.size(t) > 0, t))


def truth_sections(ids: Column) -> Column:
    """Section numbers of a `|` list; what is no whole number is skipped."""
    parts = F.transform(F.split(F.coalesce(ids, F.lit("")), r"\|"), lambda x: F.trim(x).try_cast("int"))
    return F.filter(parts, lambda x: x.isNotNull())


def truth_pairs(titles: Column, sections: Column) -> Column:
    """Titles and sections paired by place up to the shorter list."""
    n = F.least(F.size(titles), F.size(sections))
    return F.arrays_zip(F.slice(titles, 1, n).alias("title"), F.slice(sections, 1, n).alias("section_id"))


def k_values(max_k: int) -> list[int]:
    return sorted({k for k in (1, 3, 5, 10) if k <= max_k} | {max_k})


def recall_at(ranks: DataFrame, rank: str, max_k: int) -> DataFrame:
    """(k, hits, total, recall) over one row for each sample; a null rank is a miss and counts in the total."""
    ks = F.explode(F.array(*[F.lit(k) for k in k_values(max_k)])).alias("k")
    counted = ranks.select(F.col(rank).alias("r"), ks).groupBy("k").agg(F.sum(F.coalesce((F.col("r") <= F.col("k")).cast("long"), F.lit(0))).alias("hits"), F.count("*").alias("total"))
    return counted.withColumn("recall", F.col("hits") / F.col("total"))


def first_match(ranked: DataFrame, samples: DataFrame, matches: Column, rank: str) -> DataFrame:
    """(sample_id, rank): for every sample the least rank at which matches holds, or null."""
    best = ranked.filter(matches).groupBy("sample_id").agg(F.min(rank).alias("rank"))
    return samples.select("sample_id").join(best, "sample_id", "left")


def exact_match(reference, candidate) -> Column:
    """Equality after normalisation; a reference that normalises to nothing is an error."""
    return let(normalize_answer(reference), lambda r: F.when(r == "", F.raise_error(F.lit("a reference answer is empty after normalisation"))).otherwise(r == normalize_answer(candidate)))


def list_match(reference, candidate, threshold: float = 0.5) -> Column:
    """References split at &&, the candidate at commas, ` and ` and ` & `: is the share of common answers at least the threshold?"""
    clean = lambda parts: F.array_distinct(F.filter(F.transform(parts, normalize_answer), lambda x: x != ""))
    wanted = clean(F.split(col(reference), "&&"))
    given = clean(F.split(F.replace(F.replace(col(candidate), F.lit(" and "), F.lit(",")), F.lit(" & "), F.lit(",")), ","))
    share = let(wanted, lambda w: let(given, lambda g: F.size(F.array_intersect(w, g)) / F.size(F.array_union(w, g))))
    return let(wanted, lambda w: F.when(F.size(w) == 0, F.raise_error(F.lit("no reference answer is left after normalisation"))).otherwise(share >= threshold))


def best_over_references(references: Column, judge) -> Column:
    """The largest judgement over an array of references."""
    return F.array_max(F.transform(references, lambda r: judge(r).cast("double")))


def answer_correct(em: Column, equivalence: Column, threshold: float = 0.5) -> Column:
    """1 for an exact match, else 1 if the learned equivalence, an input column, reaches the threshold."""
    return F.when(em, 1.0).otherwise((F.coalesce(equivalence, F.lit(0.0)) >= threshold).cast("double"))


def consensus_accuracy(answer, references) -> Column:
    """For each annotator: a third for each other annotator's answer that equals the given one, 1 at most; the mean of all.

    Others are those whose record differs, so annotators of equal id and answer
    exclude each other. references: array of struct (answer_id, answer). They lose
    their punctuation only if they do not all agree.
    """
    refs = col(references)
    clean = lambda r: F.struct(r["answer_id"].alias("answer_id"), consensus_punctuation(r["answer"]).alias("answer"))

    def score(rs: Column) -> Column:
        def over(given: Column) -> Column:
            each = F.transform(rs, lambda g: F.least(F.lit(1.0), F.size(F.filter(rs, lambda o: ((o["answer_id"] != g["answer_id"]) | (o["answer"] != g["answer"])) & (o["answer"] == given))) / 3.0))
            return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(rs)

        return let(consensus_answer(answer), over)

    agree = F.size(F.array_distinct(F.transform(refs, lambda r: r["answer"]))) <= 1
    return let(F.when(agree, F.transform(refs, lambda r: F.struct(r["answer_id"].alias("answer_id"), r["answer"].alias("answer")))).otherwise(F.transform(refs, clean)), score)


def consensus_report(scored: DataFrame) -> DataFrame:
    """(level, name, accuracy, n): overall, by question type and by answer type, in per cent to two places, in one pass."""
    sets = scored.groupingSets([[], [F.col("question_type")], [F.col("answer_type")]], F.col("question_type"), F.col("answer_type"))
    agg = sets.agg((100 * F.avg("accuracy")).alias("accuracy"), F.count("*").alias("n"), F.grouping("question_type").alias("no_q"), F.grouping("answer_type").alias("no_a"))
    level = F.when(F.col("no_q") == 0, "question_type").when(F.col("no_a") == 0, "answer_type").otherwise("overall")
    return agg.select(level.alias("level"), F.when(F.col("no_q") == 0, F.col("question_type")).when(F.col("no_a") == 0, F.col("answer_type")).otherwise("all").alias("name"), rounded("accuracy", 2).alias("accuracy"), "n")


def direct_accuracy(answer, references) -> Column:
    """A third for each reference that equals the answer, 1 at most."""
    return F.least(F.lit(1.0), F.size(F.filter(col(references), lambda r: r == col(answer))) / 3.0)


def single_accuracy(answer, reference) -> Column:
    """Equality of both after the consensus normaliser."""
    norm = lambda c: consensus_words(consensus_punctuation(c))
    return (norm(answer) == norm(reference)).cast("double")


def retrieval_ranks(queries: DataFrame, items: DataFrame, block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(sample_id, rank) of every query and (vec_pos, rank) of every item: the best rank, from 0, of a true partner among all of the other side.

    queries has sample_id, truth and vector, items has vec_pos, label and vector; a
    pair is true where truth and label, whole numbers, are equal, and a query does not
    meet the item of its own number. Ties go to the larger number first; a rank is null
    where there is no true partner. All pairs are scored, in blocks of queries against
    batches of items: first for the best true partner, then to count what lies above it,
    so no pair becomes a row.
    """
    rows, of_query, of_item, over = items.select("vec_pos", "label", "vector"), None, None, None
    both = lambda out, part: part if out is None else out.union(part)
    blocks = list(sent_blocks(queries, "sample_id", ["sample_id", "truth", "vector"], block_rows))
    if not blocks:
        none = F.lit(None).cast("long").alias("rank")
        return queries.select("sample_id", none), items.select("vec_pos", none)
    best = lambda found: found.groupBy("id").agg(F.max(F.struct("score", "partner")).alias("best")).select("id", "best.score", "best.partner")
    for block in blocks:
        of_item = both(of_item, rows.mapInArrow(_true_partners(block, True), "id long, score double, partner long"))
    first = best(of_item).withColumnRenamed("id", "vec_pos")
    held = rows.join(first, "vec_pos").select("vec_pos", "label", "vector", "score", "partner")
    for block in blocks:
        found = {r.id: (r.score, r.partner) for r in best(rows.mapInArrow(_true_partners(block, False), "id long, score double, partner long")).collect()}
        of_query = both(of_query, rows.mapInArrow(_above(block, found), "id long, n long"))
        over = both(over, held.mapInArrow(_above(block), "id long, n long"))
    ranks = lambda counts, key: counts.groupBy(F.col("id").alias(key)).agg(F.sum("n").alias("rank"))
    return queries.select("sample_id").join(ranks(of_query, "sample_id"), "sample_id", "left"), items.select("vec_pos").join(ranks(over, "vec_pos"), "vec_pos", "left")


#: Pairs that a worker scores at a time, and what stands for no partner.
TILE, NOBODY = 1 << 20, np.iinfo(np.int64).min


def _unsent(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, truth, matrix = block.value
    return ids.astype(np.int64), truth.astype(np.float64), matrix.astype(np.float64)


def _tiles(block, batches):
    """(rows, numbers, scores, able, true) of some rows of a batch against the block; equal vectors have equal scores, wherever they are."""
    ids, truth, matrix = _unsent(block)
    step = max(1, TILE // len(ids))
    for b in batches:
        for at in range(0, len(b), step):
            t = b.slice(at, step)
            pos, label = t.column(0).to_numpy(zero_copy_only=False).astype(np.int64), t.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            v = t.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
            scores = np.einsum("qd,vd->qv", matrix, v)  # a matrix product's last bits depend on its shape
            able = np.isfinite(scores) & (ids[:, None] != pos[None, :])
            yield t, pos, scores, able, able & (truth[:, None] == label[None, :])


def _true_partners(block, of_items: bool):
    """The best true partner of each item in the block, or of each query of the block among a partition's items."""

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "score", "partner"])

    def run(batches):
        ids = _unsent(block)[0]
        best, partner = np.full(len(ids), -np.inf), np.full(len(ids), NOBODY)
        for _, pos, scores, _, true in _tiles(block, batches):
            s = np.where(true, scores, -np.inf)
            top = s.max(axis=0 if of_items else 1, keepdims=True)
            p = np.where(true & (s == top), ids[:, None] if of_items else pos[None, :], NOBODY).max(axis=0 if of_items else 1)
            top = top.ravel()
            if of_items:
                some = p != NOBODY
                yield rows(pos[some], top[some], p[some])
            else:
                up = (top > best) | ((top == best) & (p > partner))
                best, partner = np.where(up, top, best), np.where(up, p, partner)
        if not of_items:
            some = partner != NOBODY
            yield rows(ids[some], best[some], partner[some])

    return run


def _above(block, found: dict | None = None):
    """How many of the other side lie above the best true partner: for each query in found, or for each item, whose columns 3 and 4 name it."""

    def run(batches):
        ids = _unsent(block)[0]
        pick = [i for i, x in enumerate(ids.tolist()) if x in (found or {})]
        best, partner = np.array([found[ids[i]][0] for i in pick], np.float64), np.array([found[ids[i]][1] for i in pick], np.int64)
        total = np.zeros(len(pick), np.int64)
        for t, pos, scores, able, true in _tiles(block, batches):
            other = able & ~true  # no true one is above the best of them
            if found is not None:
                s, b = scores[pick], best[:, None]
                total += (other[pick] & ((s > b) | ((s == b) & (pos[None, :] > partner[:, None])))).sum(axis=1)
            else:
                b, p = (t.column(i).to_numpy(zero_copy_only=False)[None, :] for i in (3, 4))
                n = (other & ((scores > b) | ((scores == b) & (ids[:, None] > p)))).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(n.astype(np.int64))], names=["id", "n"])
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array(total)], names=["id", "n"])

    return run


def retrieval_report(image_ranks: DataFrame, text_ranks: DataFrame) -> DataFrame:
    """R@1, R@5 and R@10 in per cent for both directions, their means, and agg, the mean over texts; a null rank is a miss."""
    share = lambda k: 100.0 * F.avg(F.coalesce((F.col("rank") < k).cast("double"), F.lit(0.0)))
    ask = [share(k).alias(f"r{k}") for k in (1, 5, 10)]
    i = image_ranks.agg(*ask).select(*[F.col(f"r{k}").alias(f"txt_r{k}") for k in (1, 5, 10)])
    t = text_ranks.agg(*ask).select(*[F.col(f"r{k}").alias(f"img_r{k}") for k in (1, 5, 10)])
    mean = lambda p: (F.col(f"{p}_r1") + F.col(f"{p}_r5") + F.col(f"{p}_r10")) / 3
    both = i.withColumn("j", F.lit(1)).join(t.withColumn("j", F.lit(1)), "j").drop("j")  # a row each
    return both.withColumn("txt_r_mean", mean("txt")).withColumn("img_r_mean", mean("img")).withColumn("r_mean", (F.col("txt_r_mean") + F.col("img_r_mean")) / 2).withColumn("agg_metrics", F.col("txt_r_mean"))


def class_accuracy(rows: DataFrame, prediction: Column, target: Column) -> DataFrame:
    return rows.agg(F.sum((prediction == target).cast("long")).alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))


def argmax(scores: Column) -> Column:
    """The place of the largest score from 0, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def best_so_far(runs: DataFrame, order: str, metric: str) -> DataFrame:
    """runs with best, the largest metric up to each, and is_best where it rises."""
    w = Window.orderBy(order)  # a row for each evaluation of a model, few by nature
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("best", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("is_best", before.isNull() | (F.col(metric) > before))


def bleu4(rows: DataFrame, candidate: str = "candidate", references: str = "references") -> DataFrame:
    """Corpus BLEU of four orders: (bleu_1, bleu_2, bleu_3, bleu_4), 0 where an order has no match.

    Words are split at white space. Each n-gram counts at most as often as in the
    reference that has it most; the brevity penalty takes the reference closest in
    length, the shorter of two as close. references is an array of texts. N-grams are
    counted within a row, so a corpus needs no exchange but that of the sums.
    """
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    each = rows.select(words(F.col(candidate)).alias("c"), F.transform(references, words).alias("rs"))

    def grams(ws: Column, n: int) -> Column:
        return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))

    def matched(n: int) -> Column:
        """Sorted n-grams with a running number among equals: own ones and a reference's meet as often as both have them."""

        def numbered(gs: Column) -> Column:
            return let(F.array_sort(gs), lambda x: F.transform(x, lambda g, i: F.struct(g.alias("g"), (i - F.array_position(x, g)).alias("k"))))

        refs = F.flatten(F.transform("rs", lambda r: numbered(grams(r, n))))
        return F.size(F.array_intersect(numbered(grams(F.col("c"), n)), refs)).cast("long")

    size = F.size("c")
    near = F.transform("rs", lambda r: F.struct(F.abs(F.size(r) - size).alias("off"), F.size(r).alias("n")))
    sums = each.agg(
        *[F.sum(matched(n)).alias(f"m{n}") for n in range(1, 5)], *[F.sum(F.greatest(size - (n - 1), F.lit(0))).alias(f"t{n}") for n in range(1, 5)],
        F.sum(size).alias("n_words"), F.sum(F.array_min(near)["n"]).alias("n_reference"),
    )
    brevity = F.when(F.col("n_words") >= F.col("n_reference"), 1.0).otherwise(F.exp(1 - F.try_divide("n_reference", "n_words")))
    logs = [F.log(F.nullif(F.try_divide(f"m{n}", f"t{n}"), F.lit(0.0))) for n in range(1, 5)]
    return sums.select(*[F.coalesce(brevity * F.exp(sum(logs[1:n], logs[0]) / n), F.lit(0.0)).alias(f"bleu_{n}") for n in range(1, 5)])


def cider(rows: DataFrame, key: str = "id", candidate: str = "candidate", references: str = "references", orders: int = 4, sigma: float = 6.0, hot_grams: int = 10_000) -> DataFrame:
    """(key, cider) by consensus of n-grams with their references, for one row of each key.

    Words are split at white space. An n-gram weighs its count times ln(rows / rows
    with it in a reference, 1 at least). For each order the candidate's weights, no
    higher than the reference's, are multiplied with the reference's and divided by both
    norms; a difference in the number of bigrams costs by a normal curve; the mean over
    references and orders counts ten-fold. Rows without words or references have 0.
    An n-gram of a row is one row with its counts in the candidate and in each reference,
    and all weights are its counts times one factor. It is exchanged twice: to meet its
    count over the rows, the hot_grams most frequent in a broadcast instead, so that no
    task gets all rows of a frequent word, and as a sum for its row.
    """
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    asked = rows.select(key, words(F.col(candidate)).alias("c"), F.transform(F.coalesce(F.col(references), F.array().cast("array<string>")), words).alias("r"))
    schema = T.StructType([asked.schema[key], *T.StructType.fromDDL("n int, gram string, c int, r array<int>")])
    counts = lambda d: d.mapInArrow(_gram_counts(orders), schema)
    seen = counts(asked.withColumn("c", F.array().cast("array<string>"))).groupBy("n", "gram").agg(F.count("*").alias("df"))
    hot = F.broadcast(seen.orderBy(F.desc("df"), "n", "gram").limit(hot_grams))
    known = counts(asked).join(hot, ["n", "gram"])
    rest = counts(asked).join(hot.select("n", "gram"), ["n", "gram"], "left_anti").join(seen, ["n", "gram"], "left")
    total = rows.agg(F.log(F.count("*").cast("double")).alias("ln_rows"))
    weighed = known.select(key, "n", "c", "r", "df").union(rest.select(key, "n", "c", "r", "df")).join(F.broadcast(total))  # one row
    weight = F.col("ln_rows") - F.log(F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)).cast("double"))
    side = lambda s, square, dot: F.struct(s.cast("int").alias("side"), square.cast("double").alias("square"), dot.cast("double").alias("dot"))
    sides = F.concat(F.array(side(F.lit(-1), F.col("c") * F.col("c"), F.lit(0))), F.transform("r", lambda r, i: side(i, r * r, F.least(F.col("c"), r) * r)))
    each = weighed.select(key, "n", weight.alias("w"), F.explode(F.filter(sides, lambda s: s["square"] > 0)).alias("s"))
    sums = each.groupBy(key, "n", "s.side").agg(F.sum(F.col("w") * F.col("w") * F.col("s.square")).alias("square"), F.sum(F.col("w") * F.col("w") * F.col("s.dot")).alias("dot"))
    by_key = sums.groupBy(key).agg(F.collect_list(F.struct("n", "side", F.sqrt("square").alias("norm"), "dot")).alias("s"))
    size = lambda c: F.greatest(F.size(c) - 1, F.lit(0))  # noqa: E731  bigrams
    scored = asked.select(key, size("c").alias("c_size"), F.transform("r", size).alias("r_sizes")).join(by_key, key, "left")
    own = F.filter("s", lambda x: x["side"] == -1)

    def reference(r_size: Column, i: Column) -> Column:
        def add(sim: Column, x: Column) -> Column:
            c = F.get(F.filter(F.col("own"), lambda o: o["n"] == x["n"]), F.lit(0))["norm"]
            return sim + F.when((c != 0) & (x["norm"] != 0), x["dot"] / (c * x["norm"])).otherwise(0.0)

        sim = F.aggregate(F.filter("s", lambda x: x["side"] == i), F.lit(0.0), add)
        return F.coalesce(sim, F.lit(0.0)) * F.exp(-F.pow(F.col("c_size") - r_size, F.lit(2.0)) / (2 * sigma * sigma))

    each_reference = F.transform("r_sizes", reference)
    summed = F.aggregate(each_reference, F.lit(0.0), lambda s, x: s + x)
    mean = F.when(F.size("r_sizes") > 0, 10 * (summed / F.size("r_sizes")) / orders).otherwise(0.0)
    return scored.withColumn("own", own).select(key, mean.alias("cider"))


#: Rows of n-grams that a worker hands over at a time.
GRAMS = 20_000


def _gram_counts(orders: int):
    """Batches of (key, candidate's words, references' words) as rows of one n-gram: key, n, gram, c, r."""

    def run(batches):
        for b in batches:
            at, n_of, grams, own, refs = [], [], [], [], []
            for start in range(0, len(b), 64):
                part = b.slice(start, 64)
                for k, (c, r) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True), start):
                    for n in range(1, orders + 1):
                        found = {}
                        for side, w in enumerate((c, *r)):
                            for g in map(" ".join, zip(*(w[i:] for i in range(n)), strict=False)):
                                found.setdefault(g, [0] * (1 + len(r)))[side] += 1
                        at += [k] * len(found)
                        n_of += [n] * len(found)
                        grams += found
                        own += [x[0] for x in found.values()]
                        refs += [x[1:] for x in found.values()]
                    if len(at) >= GRAMS:
                        yield _gram_rows(b, at, n_of, grams, own, refs)
                        at, n_of, grams, own, refs = [], [], [], [], []
            if at:
                yield _gram_rows(b, at, n_of, grams, own, refs)

    return run


def _gram_rows(b, at, n_of, grams, own, refs):
    arrays = [b.column(0).take(pa.array(at)), pa.array(n_of, pa.int32()), pa.array(grams, pa.string()), pa.array(own, pa.int32()), pa.array(refs, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names=[b.schema.names[0], "n", "gram", "c", "r"])


def mean_loss(rows: DataFrame, loss: str = "loss") -> DataFrame:
    return rows.agg(F.avg(loss).alias("loss"), F.count(loss).alias("n"))
