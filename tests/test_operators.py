"""Operators against plain re-derivations on small inputs."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import scores, vectors
from quarryline.operators import graph, metrics, results, search, segments, telemetry


def test_top_k_blocks_and_ties(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_pos long, vector array<double>").repartition(3)
    q = spark.createDataFrame(rows[:7], "sample_id long, vector array<double>")
    want = {i: [p for _, p in sorted((-sum(a * b for a, b in zip(x, y)), p) for p, y in rows if p != i)[:5]] for i, x in rows[:7]}
    for block in (3, 4096):
        got = search.top_k(q, v, 5, block_rows=block).orderBy("sample_id", "rank").collect()
        assert {i: [r.vec_pos for r in got if r.sample_id == i] for i in want} == want
    with pytest.raises(ValueError):
        search.top_k(q, v, 0)
    assert search.top_k(q.limit(0), v, 5).count() == 0
    assert search.top_k(q, v.limit(0), 5).count() == 0


def test_first_per_document_skips_bad_positions(spark):
    h = spark.createDataFrame([(1, -1, 9, 0.9, 1), (1, 4, 2, 0.8, 2), (1, 5, 2, 0.7, 3), (1, 6, 3, 0.6, 4)], "sample_id long, vec_pos long, doc_idx long, score double, rank int")
    assert [(r.doc_idx, r.doc_rank) for r in search.first_per_document(h, 5).orderBy("doc_rank").collect()] == [(2, 1), (3, 2)]
    assert [(r.doc_idx, r.doc_rank) for r in search.first_per_document(h, 5, F.col("doc_idx") != 2).collect()] == [(3, 1)]


def test_scores(spark):
    d = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, float("nan")), (2, None)], "g long, x double")
    assert [r[0] for r in d.select(scores.softmax("x", "g")).collect()] == [0.5, 0.5, 0.5, 0.5]
    assert {r[0] for r in d.select("g", scores.minmax("x", "g").alias("y")).filter("g = 1").select("y").collect()} == {0.0}
    s = spark.createDataFrame([(0.0,), (None,), (math.log(3),)], "x double").select(scores.sigmoid("x", 0)).collect()
    assert [round(r[0], 9) for r in s] == [0.5, 0.5, 0.75]
    w = spark.createDataFrame([(1.0, 3.0)], "a double, b double")
    assert w.select(scores.weighted("a", "b", 1, 3), scores.weighted("a", "b", 0, 0)).first() == (2.5, 2.0)
    logits = spark.createDataFrame([([1.0],), ([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "l array<double>")
    assert [r[0] for r in logits.select(scores.positive_logit("l")).collect()] == [1.0, 2.0, 3.0]


def test_late_interaction_masks(spark):
    q, s = [[1.0, 0.0], [0.0, 2.0]], [[1.0, 1.0], [3.0, -1.0], [9.0, 9.0]]
    d = spark.createDataFrame([(q, s, [True, True, False], s[0]), (q, s, [False] * 3, s[0])], "q array<array<double>>, s array<array<double>>, m array<boolean>, c array<double>")
    a, b = d.select(vectors.maxsim("q", "s", "m").alias("max"), vectors.logsumexp("q", "s", "m").alias("lse"), vectors.cls_max("q", "c").alias("cls")).collect()
    assert a.max == 2.5 and a.cls == 2.0
    lse = np.mean([math.log(math.exp(1) + math.exp(3)) - math.log(2), math.log(math.exp(2) + math.exp(-2)) - math.log(2)])
    assert abs(a.lse - lse) < 1e-12
    assert b.max == b.lse == -1e4
    n = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(vectors.l2_normalize("v")).collect()
    assert [r[0] for r in n] == [[0.0, 0.0], [0.6, 0.8]]


def chunks(parts, most):
    """Balanced chunks, step by step."""
    sizes = [len(p) + 1 for p in parts]
    rest, expected = sum(sizes), max(1, math.ceil(sum(sizes) / most))
    done, cur, size = [], [], 0
    for p, n in zip(parts, sizes):
        if cur and (size + n > most or size >= rest / max(1, expected - len(done))):
            done.append(" ".join(cur).strip())
            rest, cur, size = rest - size, [], 0
        cur.append(p)
        size += n
    return done + ([" ".join(cur).strip()] if cur else [])


def test_balanced_chunks(spark):
    rng = random.Random(3)
    rows = [(i, ["x" * rng.randint(1, 60) for _ in range(rng.randint(0, 12))]) for i in range(60)]
    d = spark.createDataFrame(rows, "i long, p array<string>")
    for r in d.select("i", segments.balanced_chunks(F.col("p"), 80).alias("c")).collect():
        assert r.c == chunks(rows[r.i][1], 80)


def test_sections_zip_to_the_shorter_list(spark):
    d = spark.createDataFrame([(1, None, ["a", "Notes", "b", "c"], ["x", "y", "  "]), (2, "t", [], [])], "doc_idx long, title string, section_titles array<string>, section_texts array<string>")
    assert [tuple(r) for r in segments.sections(d).collect()] == [(1, "N/A", 0, "a", "x")]


def random_graph(rng, n):
    return {(i, j): rng.random() for i, j in combinations(range(n), 2) if rng.random() < 0.5}


def brute_cliques(n, edges):
    ok = lambda s: all(p in edges for p in combinations(s, 2))
    every = [s for k in range(1, n + 1) for s in combinations(range(n), k) if ok(s)]
    return sorted(s for s in every if not any(set(s) < set(t) for t in every))


@pytest.mark.parametrize("most", [6, 20])
def test_cliques_and_components(spark, most):
    rng = random.Random(5)
    graphs = {g: random_graph(rng, 6) for g in range(8)} | {8: {}}
    nodes = spark.createDataFrame([(g, i) for g in graphs for i in range(6)], "sample_id long, idx int")
    edges = spark.createDataFrame([(g, i, j, w) for g, e in graphs.items() for (i, j), w in e.items()], "sample_id long, i int, j int, weight double")
    found = graph.maximal_cliques(nodes, edges, most).collect()
    for g, e in graphs.items():
        assert sorted(tuple(r.members) for r in found if r.sample_id == g) == brute_cliques(6, e)
    label = {(r.sample_id, r.idx): r.component for r in graph.components(nodes, edges, 6).collect()}
    for g, e in graphs.items():
        parts = graph._parts(list(range(6)), {v: {b if a == v else a for a, b in e if v in (a, b)} for v in range(6)})
        assert {label[g, v] for v in range(6)} == {min(p) for p in parts}
        assert all(label[g, v] == min(p) for p in parts for v in p)


def test_greedy_prune():
    w = np.array([[0, 0.9, 0.8, 0.0], [0.9, 0, 0.7, 0.1], [0.8, 0.7, 0, 0.0], [0.0, 0.1, 0.0, 0]])
    assert graph.greedy_prune([0, 1, 2, 3], w, 3)[0] == [0, 1, 2]
    kept, score, removed = graph.greedy_prune([0, 1, 2, 3], w, 1)
    assert removed[0] == 3 and len(kept) == 1 and score == 0.0
    assert graph.greedy_prune([0, 3], w, 1) == ([0, 3], 0.0, [])


def test_contradictions_never_raise_consistency(spark):
    rel = lambda con: spark.createDataFrame([(1, 0, 1, 0.9, 0.1 - con, con, 0.9, 0.1 - con, con)], "sample_id long, i int, j int, ent_ij double, neu_ij double, con_ij double, ent_ji double, neu_ji double, con_ji double")
    weight = lambda con: graph.relation_edges(graph.average_relations(rel(con)), tau=0.0).first().weight
    assert weight(0.1) < weight(0.05) < weight(0.0)
    zero = graph.relation_edges(graph.average_relations(rel(0.1)), alpha=0.0, tau=0.0, e_min=0.0, margin=-1.0).collect()
    assert [r.weight for r in zero] == [0.0]  # a weight of tau is an edge


def test_recall_is_monotone_and_counts_misses(spark):
    r = metrics.recall_at(spark.createDataFrame([(1,), (4,), (None,)], "rank int"), "rank", 20).orderBy("k").collect()
    assert [(x.k, x.hits, x.total) for x in r] == [(1, 1, 3), (3, 1, 3), (5, 2, 3), (10, 2, 3), (20, 2, 3)]
    assert metrics.k_values(4) == [1, 3, 4]


def test_answer_matching(spark):
    d = spark.createDataFrame([("the Cat", "a cat!"), ("dog", "cat")], "r string, c string")
    assert [x[0] for x in d.select(metrics.exact_match("r", "c")).collect()] == [True, False]
    with pytest.raises(Exception, match="empty"):
        spark.createDataFrame([("the", "a")], "r string, c string").select(metrics.exact_match("r", "c")).collect()
    m = spark.createDataFrame([("one && two", "1 and 2"), ("one and two", "1&&2"), ("a1 && b1 && c1", "a1, x1")], "r string, c string")
    assert [x[0] for x in m.select(metrics.list_match("r", "c")).collect()] == [True, False, False]


def test_truth(spark):
    d = spark.createDataFrame([("A|A|B", "http://x/wiki/C_c", "1| x |2|3.0"), (None, None, None)], "t string, u string, s string")
    a, b = d.select(metrics.truth_titles(F.col("t"), F.col("u")).alias("t"), metrics.truth_sections(F.col("s")).alias("s")).select("t", "s", metrics.truth_pairs(F.col("t"), F.col("s")).alias("p")).collect()
    assert a.t == ["a", "b", "c c"] and a.s == [1, 2] and [tuple(x) for x in a.p] == [("a", 1), ("b", 2)]
    assert b.t is None


def test_telemetry(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0, 1.0, True)], "stage string, latency_s double, peak_vram_gb double, energy_j double, is_warmup boolean")
    s = telemetry.stage_summary(rows).first()
    assert s["count"] == 0 and s["latency_mean"] == 0.0 and s["energy_total"] == 0.0
    p = spark.createDataFrame([("s", 1.0, 10.0), ("s", 3.0, 20.0)], "series_id string, t double, watts double")
    assert telemetry.energy(p).first().energy_j == 30.0
    assert telemetry.energy(p, since=F.lit(0.0)).first().energy_j == 40.0
    x = spark.createDataFrame([(i, i % 3 != 0) for i in range(10)], "i long, ok boolean")
    assert [r.i for r in telemetry.warm_up(x, "i", F.col("ok"), 3).filter("is_warmup").orderBy("i").collect()] == [0, 1, 2, 3, 4]
    m = telemetry.smoothed(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([4, 1, 3, 2])], "s string, i long, v double"), "s", ["i"], "v", 3).orderBy("i").collect()
    assert [r.median for r in m] == [4.0, 1.0, 3.0, 2.0]


def test_results(spark):
    a = spark.createDataFrame([(1, 0, "x"), (2, 1, "y")], "k long, pos long, v string")
    b = spark.createDataFrame([(2, 0, "z"), (3, 1, "w")], "k long, pos long, v string")
    assert sorted((r.k, r.v) for r in results.merge_shards([a, b], "k", "pos").collect()) == [(1, "x"), (2, "y"), (3, "w")]
    with pytest.raises(Exception, match="differ"):
        results.attach_annotations(a.withColumnRenamed("k", "question_id"), b.withColumnRenamed("k", "question_id").select("question_id"), "question_id").collect()
    assert results.filter_any(a, k=[], v=["x"]).count() == 1
    c = spark.createDataFrame([(["ab", "a", "cd", "d", "xcd"],)], "c array<string>").select(search.without_contained(F.col("c"))).first()[0]
    assert c == ["ab", "cd", "xcd"]
    s = search.weighted_sample(spark.createDataFrame([(1, i, float(i > 0)) for i in range(5)], "sample_id long, item long, w double"), 2, "w", 3)
    assert s.count() == 2 and s.filter("item = 0").count() == 0


def test_partition_count_does_not_matter(spark):
    rng = random.Random(8)
    rows = [(1, i, rng.random()) for i in range(30)]
    d = spark.createDataFrame(rows, "sample_id long, item long, score double").withColumns({"doc_rank": F.lit(0), "section_idx": F.col("item")})
    a, b = ([tuple(r) for r in search.rank_sections(d.repartition(n), F.col("score")).orderBy("section_rank").collect()] for n in (1, 8))
    assert a == b


def test_bleu(spark):
    from collections import Counter

    pairs = [("the cat sat on the mat today", ["the cat sat on a mat", "a cat is on the mat today now"]), ("the the the the", ["the cat"]), ("one two three four five", ["one two three four five"])]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    size = near = 0
    m, t = [0] * 5, [0] * 5
    for c, rs in pairs:
        c, rs = c.split(), [r.split() for r in rs]
        size, near = size + len(c), near + min((abs(len(r) - len(c)), len(r)) for r in rs)[1]
        for n in range(1, 5):
            own = grams(c, n)
            m[n] += sum(min(k, max(grams(r, n)[g] for r in rs)) for g, k in own.items())
            t[n] += max(0, len(c) - n + 1)
    short = 1.0 if size >= near else math.exp(1 - near / size)
    got = metrics.bleu4(spark.createDataFrame(pairs, "candidate string, references array<string>")).first()
    for n in range(1, 5):
        assert got[n - 1] == pytest.approx(short * math.exp(sum(math.log(m[k] / t[k]) for k in range(1, n + 1)) / n))
    assert tuple(metrics.bleu4(spark.createDataFrame([("a", ["b"])], "candidate string, references array<string>")).first()) == (0.0, 0.0, 0.0, 0.0)


def test_prompts(spark):
    from quarryline.functions import prompts

    d = spark.createDataFrame([(["cat.", "dog."], ["c0 ", "c1 ", "c2 "], {"dog": [1, 2], "cat": [1]})], "a array<string>, c array<string>, i map<string,array<int>>")
    # dog: 1; cat: nothing new; dog: 2; cat: nothing new.
    assert d.select(prompts.context_prompt("a", "c", "i", 4)).first()[0] == "c1 c2 "
    assert d.select(prompts.context_prompt("a", "c", F.create_map(F.lit("x"), F.array(F.lit(0))), 2)).first()[0] == "c0 "
    s = spark.createDataFrame([([7], [[1, 2], [3]], [4])], "c array<int>, h array<array<int>>, a array<int>").select(prompts.dialogue_sequence("c", "h", "a", 0, (10, 20), 30).alias("x")).first().x
    assert s.input_ids == [7, 0, 1, 2, 0, 3, 0, 4, 0]
    assert s.token_type_ids == [30, 30, 10, 10, 10, 20, 20, 10, 10]
    assert s.labels == [-1] * 7 + [4, 0]
    f = spark.createDataFrame([("Q ", [" A", "b", "C", "d"])], "q string, c array<string>")
    assert f.select(prompts.fid_inputs("q", "c", 4, 3)).first()[0] == ["q \\n a. b. c.", "q \\n d."]
    assert f.select(prompts.fid_inputs("q", "c", 5, 3)).first()[0] == ["q \\n a. b. c."]


def test_word_pieces(spark):
    public = pytest.importorskip("public_tokenizers")
    from quarryline.functions import prompts

    rows = spark.createDataFrame([("a photo of a cat",), (None,), ("word " * 200,)], "t string").select(prompts.word_pieces(public.path("word_bpe_49k.json"))("t")).collect()
    a, b, c = (r[0] for r in rows)
    assert len(a) == len(b) == len(c) == 77 and a[0] == 49406 and 49407 in a and b[:2] == [49406, 49407] and c[-1] == 49407


def test_shortlists(spark):
    c = spark.createDataFrame([(1, 0, "a", 0.9, 5.0), (1, 1, "b", 0.8, 1.0), (1, 2, "c", 0.1, 0.0)], "sample_id long, answer_no int, answer string, first_prob double, loss double")
    assert search.answer_shortlist(c, 2).first().answer == "b"
    s = spark.createDataFrame([(1, 1, 0, "t", [1.0, 0.0]), (1, 2, 0, "u", [1.0, 0.0])], "sample_id long, doc_idx long, section_idx int, source_title string, vector array<double>")
    h = spark.createDataFrame([(1, "t", [1.0, 1.0]), (1, "t", [2.0, 0.0])], "sample_id long, title string, vector array<double>")
    assert {(r.doc_idx, r.similarity) for r in search.cosine_by_title(s, h).collect()} == {(1, 1.0), (2, -1.0)}


def test_components_by_masks_equal_those_by_joins(spark):
    import random

    from quarryline.operators import graph

    rng = random.Random(3)
    nodes = spark.createDataFrame([(s, i) for s in range(6) for i in range(60)], "sample_id long, idx int")
    edges = spark.createDataFrame([(s, *sorted(rng.sample(range(60), 2))) for s in range(6) for _ in range(35)], "sample_id long, i int, j int")
    by_masks, by_joins = ({(r.sample_id, r.idx): r.component for r in graph.components(nodes, edges, m).collect()} for m in (60, 63))
    assert by_masks == by_joins and len(by_masks) == 360


def test_rankings_of_five_scores(spark):
    from quarryline.operators import search

    rows = [(1, 10, 1, 0, 0.9, 0.1, 0.5, 0.2), (1, 10, 1, 1, 0.9, 0.3, 0.4, 0.1), (1, 20, 2, 0, 0.1, 0.2, 0.9, 0.3)]
    d = spark.createDataFrame(rows, "sample_id long, doc_idx long, doc_rank int, section_idx int, vision double, cls_max double, maxsim double, lse double")
    got = {}
    for r in search.rank_variants(d).orderBy("variant", "section_rank").collect():
        got.setdefault(r.variant, []).append((r.doc_idx, r.section_idx, r.doc_place))
    assert got["cls_max"] == [(10, 1, 1), (20, 0, 2), (10, 0, 3)]
    assert got["logsumexp"] == [(20, 0, 1), (10, 0, 2), (10, 1, 3)]
    assert got["vision_maxsim"] == [(10, 0, 1), (10, 1, None), (20, 0, 2)]  # documents count once
    assert got["vision_cls_max"] == [(10, 1, 1), (10, 0, None), (20, 0, 2)]


def test_score_by_document_is_zero_where_there_is_none(spark):
    from quarryline.operators import search

    sections = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "sample_id long, doc_idx long")
    found = search.score_by_document(sections, spark.createDataFrame([(1, 5, 0.7)], "sample_id long, doc_idx long, v double"), "v")
    assert {(r.sample_id, r.doc_idx): r.v for r in found.collect()} == {(1, 5): 0.7, (1, 6): 0.0, (2, 5): 0.0}


def test_first_tokens_are_cut_and_filled_up(spark):
    from quarryline.functions import vectors

    d = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [True, True])], "t array<array<double>>, m array<boolean>")
    for n, tokens, mask in ((1, [[1.0, 2.0]], [True]), (3, [[1.0, 2.0], [3.0, 4.0], [0.0, 0.0]], [True, True, False])):
        t, m = vectors.first_tokens("t", "m", n)
        assert tuple(d.select(t, m).first()) == (tokens, mask)


def test_captions_stop_at_n(spark):
    from quarryline.operators import search

    d = spark.createDataFrame([(["a cat", "cat", "dog", "a dog", "sun"],)], "c array<string>")
    assert d.select(search.without_contained(F.col("c"))).first()[0] == ["a cat", "dog", "a dog", "sun"]
    assert d.select(search.without_contained(F.col("c"), 2)).first()[0] == ["a cat", "dog"]


def test_many_blocks_of_queries_give_the_same_hits(spark):
    import numpy as np

    from quarryline.operators import search

    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "vec_pos long, vector array<double>")
    q = v.filter("vec_pos % 3 = 0").withColumnRenamed("vec_pos", "sample_id")
    one, many = (sorted(map(tuple, search.top_k(q, v, 5, n).select("sample_id", "vec_pos", "rank").collect())) for n in (4096, 9))
    assert one == many and len(one) == 500
    assert search.top_k(q.limit(0), v, 5).count() == 0


def cider_by_hand(rows, sigma=6.0):
    """Consensus scores from the definition, row by row."""
    import math
    from collections import Counter

    def grams(text, n):
        w = (text or "").split()
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    out = {}
    for key, cand, refs in rows:
        score = []
        for ref in refs:
            total = 0.0
            for n in range(1, 5):
                df = Counter(g for _, _, rs in rows for g in set().union(*(grams(r, n) for r in rs)))
                weigh = lambda t: {g: c * (math.log(len(rows)) - math.log(max(1, df[g]))) for g, c in grams(t, n).items()}  # noqa: B023,E731
                c, r = weigh(cand), weigh(ref)
                norm = math.sqrt(sum(x * x for x in c.values())) * math.sqrt(sum(x * x for x in r.values()))
                dot = sum(min(x, r[g]) * r[g] for g, x in c.items() if g in r)
                total += dot / norm if norm else 0.0
            off = sum(grams(cand, 2).values()) - sum(grams(ref, 2).values())
            score.append(total / 4 * math.exp(-off * off / (2 * sigma * sigma)))
        out[key] = 10 * sum(score) / len(score) if score else 0.0
    return out


def test_cider_equals_the_definition(spark):
    from quarryline.operators import metrics

    rows = [(1, "a cat sits on a mat", ["the cat sits on the mat", "a cat on a mat"]), (2, "a dog runs", ["a dog runs fast", "the dog"]), (3, "", ["nothing here"]), (4, "a red sun", []), (5, None, ["x"]), (6, "the sky is blue", ["the sky is blue"])]
    d = spark.createDataFrame(rows, "id long, candidate string, references array<string>")
    for hot in (0, 3, 10_000):
        got = {r.id: r.cider for r in metrics.cider(d, hot_grams=hot).collect()}
        want = cider_by_hand(rows)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want), (got, want)
    assert metrics.cider(d.limit(0)).count() == 0


def test_sentences_do_not_end_after_abbreviations(spark):
    from quarryline.operators import segments

    d = spark.createDataFrame([("Dr. No met Mr. Bond. They left! At 5 p.m. sharp?",)], "t string")
    assert d.select(segments.sentences_of(F.col("t"), ("Dr", "Mr", "p.m"))).first()[0] == ["Dr. No met Mr. Bond.", "They left!", "At 5 p.m. sharp?"]
    assert d.select(segments.sentences_of(F.col("t"))).first()[0][0] == "Dr."
