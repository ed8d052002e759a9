"""Registered queries and the SQL that says what each must return.

Numbers with fractions are rounded in both, after all ranking, to places where no
true value lies half-way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts, scores, text, vectors
from ..functions.answer_tables import CONSENSUS_PUNCTUATION, CONTRACTIONS, NUMBER_WORDS, PUNCTUATION, VERDICT_WORDS
from ..operators import graph, metrics, results, search, segments, telemetry
from . import config, flows
from . import relations as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return scores.rounded(c, 6)


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _map_sql(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_literal(k)}: {_literal(v)}" for k, v in table.items()) + "}"


# Text


@query(f"SELECT doc_id, {rel.NORMALIZED.format('text')} AS title FROM documents")
def normalize_title(spark, sf_dir):
    return rel.table(spark, sf_dir, "documents").select("doc_id", text.normalize_title("text").alias("title"))


@query(rf"""WITH u AS (SELECT page_id, regexp_replace(url, '/[a-z][a-z]/', '/wiki/Caf%C3%A9_+_') AS url FROM pages)
SELECT page_id, {rel.NORMALIZED.format("replace(url_decode(replace(regexp_extract(url, '/wiki/([^#?]*)', 1), '+', '%2B')), '_', ' ')")} AS title FROM u""")
def url_to_title(spark, sf_dir):
    wiki = F.regexp_replace("url", "^(.*?)/[a-z][a-z]/", "$1/wiki/Caf%C3%A9_+_")
    return rel.table(spark, sf_dir, "pages").select("page_id", text.url_to_title(wiki).alias("title"))


_LISTED = "(contains(t, 'list of') OR contains(t, 'outline of') OR contains(t, 'index of'))"


@query(f"WITH {rel.TITLED}, n AS (SELECT doc_idx, {rel.NORMALIZED.format('title')} AS t FROM titled) SELECT doc_idx, t AS title FROM n WHERE NOT {_LISTED}")
def list_page_filter(spark, sf_dir):
    return rel.titled(spark, sf_dir).filter(~text.is_list_page("title")).select("doc_idx", text.normalize_title("title").alias("title"))


@query(f"""WITH {rel.TITLED}, s AS (SELECT doc_idx, title, unnest(range(0, len(lines))) AS section_idx, unnest(lines) AS section_text FROM titled),
n AS (SELECT *, CASE WHEN section_idx % 9 = 4 THEN ' See also ' WHEN section_idx % 9 = 7 THEN 'Notes' ELSE 'Part ' || section_idx END AS section_title FROM s)
SELECT doc_idx, title AS source_title, CAST(section_idx AS INTEGER) AS section_idx, section_title, section_text FROM n
WHERE trim(lower(section_title)) NOT IN ('references', 'external links', 'see also', 'notes', 'bibliography', 'further reading') AND regexp_matches(section_text, '\\S')""")
def section_split(spark, sf_dir):
    return segments.sections(rel.titled(spark, sf_dir))


_SENT = r"list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


# A fold over sentences; what has been joined so far is the struct of the last sentence.
@query(rf"""WITH {rel.TITLED}, s AS (SELECT doc_idx, unnest(range(0, len(lines))) AS i, unnest(lines) AS text FROM titled),
n AS (SELECT doc_idx, i, 'Part ' || i AS section_title, {_SENT.replace("text,", "trim(text, ' ' || chr(9) || chr(10) || chr(13)),", 1)} AS p FROM s WHERE i % 9 NOT IN (4, 7) AND regexp_matches(text, '\S')),
z AS (SELECT *, list_sum(list_transform(p, lambda x: length(x) + 1)) AS size FROM n WHERE len(p) > 0),
f AS (SELECT *, list_reduce(list_transform(p, lambda x: {{'done': []::VARCHAR[], 'cur': [x], 'n': length(x) + 1, 'rest': size, 'want': greatest(1, ceil(size / 400.0))}}), lambda a, x:
  CASE WHEN a.n + x.n > 400 OR a.n >= a.rest / greatest(1, a.want - len(a.done)) THEN {{'done': list_append(a.done, array_to_string(a.cur, ' ')), 'cur': x.cur, 'n': x.n, 'rest': a.rest - a.n, 'want': a.want}}
  ELSE {{'done': a.done, 'cur': list_concat(a.cur, x.cur), 'n': a.n + x.n, 'rest': a.rest, 'want': a.want}} END) AS f FROM z),
c AS (SELECT doc_idx, i, section_title, list_append(f.done, array_to_string(f.cur, ' ')) AS c FROM f),
u AS (SELECT doc_idx, i, section_title, unnest(range(0, len(c))) AS k, unnest(c) AS section_text FROM c)
SELECT doc_idx, CAST(i AS INTEGER) AS section_idx, CAST(k AS INTEGER) AS paragraph_idx, section_title || ' [para ' || k || ']' AS section_title, section_text FROM u""")
def balanced_chunks(spark, sf_dir):
    return segments.paragraphs(segments.sections(rel.titled(spark, sf_dir)), 400).select("doc_idx", "section_idx", "paragraph_idx", "section_title", "section_text")


@query(rf"""WITH s AS (SELECT doc_id AS doc_idx, {_SENT.replace("text,", "trim(text, ' ' || chr(9) || chr(10) || chr(13)),", 1)} AS p FROM documents)
SELECT doc_idx, CAST(unnest(range(0, len(p))) AS INTEGER) AS sentence_idx, unnest(p) AS sentence FROM s""")
def sentence_split(spark, sf_dir):
    return rel.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_idx"), F.posexplode(segments.sentences_of(F.col("text"))).alias("sentence_idx", "sentence"))


_MARKS = "[.!\"()*#:;~]"


@query(rf"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '{_MARKS}', ' ', 'g'), '\s{{2,}}', ' ', 'g'), '\n+$', ''), ' ') AS c FROM documents)
SELECT doc_id, array_to_string(string_split(c, ' ')[1:50], ' ') AS caption FROM c""")
def pre_caption(spark, sf_dir):
    return rel.table(spark, sf_dir, "documents").select("doc_id", text.pre_caption("text").alias("caption"))


@query(rf"SELECT doc_id, array_to_string(string_split(rtrim(regexp_replace(lower(text), '{_MARKS}', '', 'g'), ' '), ' ')[1:50], ' ') AS question FROM documents")
def pre_question(spark, sf_dir):
    return rel.table(spark, sf_dir, "documents").select("doc_id", text.pre_question("text").alias("question"))


@query("""SELECT doc_id, '# Wiki Article: ' || lang || chr(10) || '## Section Title: ' || source || chr(10) || text AS section FROM documents""")
def section_header(spark, sf_dir):
    return rel.table(spark, sf_dir, "documents").select("doc_id", text.section_header("lang", "source", "text").alias("section"))


# The answer normaliser's word boundary is Unicode's: articles next to an accented letter are part of a word.
_ANSWER = rf"""array_to_string(list_transform(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(
  ' ' || regexp_replace(translate(translate(trim(lower(@@), ' ' || chr(10) || chr(9)), chr(10) || chr(9), '  '), {_literal(PUNCTUATION)}, ''), '\s+', '  ', 'g') || ' ',
  ' the  answer  is ', '  ', 'g'), ' (a|an|the) ', '  ', 'g'), '\s+'), lambda x: x <> ''),
  lambda w: coalesce({_map_sql(NUMBER_WORDS | VERDICT_WORDS)}[w], w)), lambda w: coalesce({_map_sql(CONTRACTIONS)}[w], w)), ' ')"""


def _answer_sql(c: str) -> str:
    return _ANSWER.replace("@@", c)


@query(f"SELECT conv_id, turn, {_answer_sql('text')} AS answer FROM conversations")
def answer_normalize(spark, sf_dir):
    return rel.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_answer("text").alias("answer"))


def _consensus_punct_sql(c: str) -> str:
    out = c
    for p in CONSENSUS_PUNCTUATION:
        q = _literal(p)
        out = rf"replace({out}, {q}, CASE WHEN contains({c}, {q} || ' ') OR contains({c}, ' ' || {q}) OR regexp_matches({c}, '\d,\d') THEN '' ELSE ' ' END)"
    return out


# The texts of the tables have fewer than 33 full stops to remove or the rest stays, as in the operator.
_STOPS = r"""list_reduce(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i > 33 THEN '.' || p[i] ELSE p[i] END), lambda a, b: a || b)"""
_WORDS = f"""array_to_string(list_transform(list_filter(list_transform(list_filter(string_split_regex(lower(x), '\\s+'), lambda w: w <> ''), lambda w: coalesce({_map_sql(NUMBER_WORDS)}[w], w)), lambda w: w NOT IN ('a', 'an', 'the')), lambda w: coalesce({_map_sql(CONTRACTIONS)}[w], w)), ' ')"""


@query(rf"""WITH s AS (SELECT conv_id, turn, trim(translate(text, chr(10) || chr(9), '  '), ' ') AS t FROM conversations),
m AS (SELECT conv_id, turn, {_consensus_punct_sql('t')} AS m FROM s),
k AS (SELECT conv_id, turn, string_split(regexp_replace(replace(m, '.', chr(1)), chr(1) || '(\d)', '.\1', 'g'), chr(1)) AS p FROM m),
x AS (SELECT conv_id, turn, {_STOPS} AS x FROM k)
SELECT conv_id, turn, {_WORDS} AS answer FROM x""")
def consensus_normalize(spark, sf_dir):
    return rel.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.consensus_answer("text").alias("answer"))


# Vector search and ranking


@query(f"WITH {rel.HITS} SELECT sample_id, vec_pos, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 20")
def knn_topk(spark, sf_dir):
    return rel.hits(spark, sf_dir).filter("rank <= 20").select("sample_id", "vec_pos", r6("score").alias("score"), "rank")


@query(f"WITH {rel.DOC_HITS} SELECT sample_id, doc_idx, round(score, 6) AS score, CAST(doc_rank AS INTEGER) AS doc_rank FROM doc_hits")
def knn_first_per_document(spark, sf_dir):
    return rel.doc_hits(spark, sf_dir).select("sample_id", "doc_idx", r6("score").alias("score"), "doc_rank")


@query(f"""WITH {rel.HITS}, d AS (SELECT sample_id, doc_idx, max(score) AS score, min(rank) AS f FROM hits GROUP BY ALL)
SELECT sample_id, doc_idx, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY f) AS INTEGER) AS doc_rank FROM d""")
def knn_dedup_maxscore(spark, sf_dir):
    return search.best_per_document(rel.hits(spark, sf_dir)).withColumn("score", r6("score"))


_KS = "(SELECT unnest([1, 3, 5, 10, 20]) AS k)"


@query(f"""WITH {rel.DOC_HITS}, best AS (SELECT q.sample_id, min(doc_rank) AS r FROM q LEFT JOIN doc_hits d ON q.sample_id = d.sample_id AND d.label = d.truth GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, CAST(count(*) FILTER (r <= k) AS BIGINT) AS hits, count(*) AS total, count(*) FILTER (r <= k) / count(*) AS recall FROM best, {_KS} GROUP BY k""")
def image_search_recall(spark, sf_dir):
    s = rel.samples(spark, sf_dir)
    ranked = rel.doc_hits(spark, sf_dir).join(s.select("sample_id", "truth"), "sample_id")
    return metrics.recall_at(metrics.first_match(ranked, s, F.col("label") == F.col("truth"), "doc_rank"), "rank", 20)


@query(f"""WITH {rel.HITS}, first AS (SELECT doc_idx, min(vec_pos) AS first_pos, count(*) AS n FROM v GROUP BY doc_idx)
SELECT h.sample_id, h.vec_pos, CASE WHEN h.vec_pos - first_pos < 5 THEN 'img' || h.doc_idx || '/' || (h.vec_pos - first_pos) END AS image_url, CASE WHEN h.vec_pos - first_pos < 3 THEN 'view ' || (h.vec_pos - first_pos) ELSE '' END AS description
FROM hits h JOIN first USING (doc_idx)""")
def hit_images(spark, sf_dir):
    first = rel.vectors(spark, sf_dir).groupBy("doc_idx").agg(F.min("vec_pos").alias("first_pos"))
    urls = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("img"), F.col("doc_idx").cast("string"), F.lit("/"), i.cast("string")))
    docs = first.withColumns({"image_urls": urls, "descriptions": F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("view "), i.cast("string")))})
    return search.image_of(rel.hits(spark, sf_dir), docs).select("sample_id", "vec_pos", "image_url", "description")


@query(f"""WITH {rel.DOC_HITS}, e AS (SELECT sample_id, doc_idx, exp(score / 0.5 - max(score / 0.5) OVER (PARTITION BY sample_id)) AS e FROM doc_hits)
SELECT sample_id, doc_idx, round(e / sum(e) OVER (PARTITION BY sample_id), 6) AS img_norm FROM e""")
def doc_softmax(spark, sf_dir):
    return rel.doc_hits(spark, sf_dir).select("sample_id", "doc_idx", r6(scores.softmax("score", "sample_id", 0.5)).alias("img_norm"))


@query(f"""WITH {rel.CANDIDATES}, t AS (SELECT sample_id, 'title ' || (doc_idx % 13) AS title, max_by(similarity, idx) AS img_norm FROM cand WHERE idx % 2 = 0 GROUP BY ALL),
f AS (SELECT c.sample_id, c.idx, 1 / (1 + exp(-rerank / 2)) AS rerank_norm, coalesce(img_norm, 0) AS img_norm FROM cand c LEFT JOIN t ON t.sample_id = c.sample_id AND t.title = 'title ' || (c.doc_idx % 13)),
g AS (SELECT *, 0.3::DOUBLE * img_norm + 0.7::DOUBLE * rerank_norm AS combined FROM f)
SELECT sample_id, idx, round(rerank_norm, 6) AS rerank_norm, round(img_norm, 6) AS img_norm, round(combined, 6) AS combined, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY combined DESC, idx) AS INTEGER) AS section_rank FROM g""")
def sigmoid_fusion(spark, sf_dir):
    c = rel.candidates(spark, sf_dir).withColumn("title", F.concat(F.lit("title "), (F.col("doc_idx") % 13).cast("string")))
    docs = c.filter("idx % 2 = 0").select("sample_id", "title", F.col("idx").alias("doc_rank"), F.col("similarity").alias("img_norm"))
    s = search.score_by_title(c, docs, "img_norm").withColumn("rerank_norm", scores.sigmoid("rerank", 2.0))
    s = s.withColumns({"combined": scores.weighted("img_norm", "rerank_norm", 0.3, 0.7), "doc_rank": F.lit(0), "section_idx": F.col("idx")})
    return search.rank_sections(s, F.col("combined")).select("sample_id", "idx", r6("rerank_norm").alias("rerank_norm"), r6("img_norm").alias("img_norm"), r6("combined").alias("combined"), "section_rank")


@query(f"""WITH {rel.CANDIDATES}, e AS (SELECT sample_id, exp(similarity - max(similarity) OVER (PARTITION BY sample_id)) AS e FROM cand),
p AS (SELECT sample_id, e / sum(e) OVER (PARTITION BY sample_id) AS p FROM e), h AS (SELECT sample_id, -sum(p * ln(p + 1e-12::DOUBLE)) AS h, count(*) AS n FROM p GROUP BY sample_id),
c AS (SELECT sample_id, h, n, 1 - h / ln(n::DOUBLE) AS c FROM h)
SELECT sample_id, round(h, 6) AS entropy, round(c, 6) AS confidence, CAST(CASE WHEN c >= 0.002 THEN 1 ELSE greatest(1, ceil((1 - c) * n)) END AS BIGINT) AS keep_n FROM c""")
def topm_confidence(spark, sf_dir):
    ranked = rel.candidates(spark, sf_dir).withColumn("section_rank", F.col("idx") + 1)
    return search.confidence(ranked, "similarity", rel.M, 0.002).withColumns({"entropy": r6("entropy"), "confidence": r6("confidence")})


@query(f"""WITH {rel.CANDIDATES} SELECT sample_id, idx, round((rerank - min(rerank) OVER w) / (max(rerank) OVER w - min(rerank) OVER w), 6) AS norm FROM cand WINDOW w AS (PARTITION BY sample_id)""")
def minmax_norm(spark, sf_dir):
    return rel.candidates(spark, sf_dir).select("sample_id", "idx", r6(scores.minmax("rerank", "sample_id")).alias("norm"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, round(sqrt(list_dot_product(x, x)), 6) AS norm, list_transform(x, lambda y: round(y / sqrt(list_dot_product(x, x)), 6)) AS unit FROM e""")
def l2_normalize(spark, sf_dir):
    e = rel.table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles("embedding").alias("x"))
    return e.select("vec_id", r6(vectors.norm("x")).alias("norm"), scores.rounded_each(vectors.l2_normalize("x")).alias("unit"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id, a.x, b.x AS d FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(x, lambda v: round(v, 6)) ELSE list_transform(range(1, len(x) + 1), lambda i: round(0.7::DOUBLE * x[i] + 0.3::DOUBLE * d[i], 6)) END AS fused,
round(list_dot_product(x, d) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(d, d)), 6) AS cosine FROM p""")
def description_fusion(spark, sf_dir):
    e = rel.table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles("embedding").alias("x"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("d")), "vec_id")
    said = F.when(F.col("vec_id") % 3 == 0, F.lit("  ")).otherwise(F.lit("a view"))
    return p.select("vec_id", scores.rounded_each(vectors.fuse("x", "d", said, 0.7)).alias("fused"), r6(vectors.cosine("x", "d")).alias("cosine"))


# Late interaction: token matrices are runs of eight vectors; a token is masked where its number divides by 5.
_TOKENS = """
tok AS (SELECT vec_id // 8 AS sec, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) FILTER (vec_id % 5 <> 0) AS kept, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS every, min(label) AS label FROM embeddings GROUP BY ALL HAVING count(*) = 8),
prod AS (SELECT q.sec AS qry, s.sec AS sec, list_transform(q.every[1:4], lambda a: list_transform(s.kept, lambda b: list_dot_product(a, b))) AS m, list_transform(q.every[1:4], lambda a: list_dot_product(a, s.every[1])) AS c, q.label AS ql, s.label AS sl
  FROM tok q JOIN tok s ON q.sec <> s.sec AND q.sec % 100 = 0),
late AS (SELECT qry, sec, ql, sl, list_max(c) AS cls_max, list_avg(list_transform(m, lambda r: list_max(r))) AS maxsim,
  list_avg(list_transform(m, lambda r: list_max(r) + ln(list_sum(list_transform(r, lambda x: exp(x - list_max(r))))) - ln(len(r)::DOUBLE))) AS lse FROM prod)"""


def _late(spark, sf_dir):
    """Each section that starts at a multiple of 100 as a query of four tokens, against all other sections."""
    e = rel.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("long").alias("sec"), "vec_id", vectors.doubles("embedding").alias("x"))
    rows = e.groupBy("sec").agg(F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias("t")).filter(F.size("t") == 8)
    s = rows.select("sec", F.transform("t", lambda r: r["x"]).alias("tokens"), F.transform("t", lambda r: r["vec_id"] % 5 != 0).alias("mask"))
    q = s.filter("sec % 100 = 0").select(F.col("sec").alias("qry"), F.slice("tokens", 1, 4).alias("q"))
    return search.late_scores(q, s)


@query(f"WITH {_TOKENS} SELECT qry, sec, round(cls_max, 6) AS cls_max, round(maxsim, 6) AS maxsim, round(lse, 6) AS lse FROM late")
def late_interaction(spark, sf_dir):
    return _late(spark, sf_dir).select("qry", "sec", *[r6(c).alias(c) for c in ("cls_max", "maxsim", "lse")])


@query(f"""WITH {rel.SECTION_SCORES} SELECT sample_id, variant, doc_idx, CAST(section_idx AS INTEGER) AS section_idx, round(variant_score, 6) AS score, CAST(section_rank AS INTEGER) AS section_rank, CAST(doc_place AS INTEGER) AS doc_place FROM vplaced""")
def rerank_variants(spark, sf_dir):
    r = search.rank_variants(rel.section_scores(spark, sf_dir))
    return r.select("sample_id", "variant", "doc_idx", "section_idx", r6("variant_score").alias("score"), "section_rank", "doc_place")


_RECALLED = f"""{rel.SECTION_SCORES},
vbest AS (SELECT sample_id, variant, min(doc_place) FILTER (label = truth) AS document, min(section_rank) FILTER (label = truth AND sample_id % 300 <> 0 AND section_idx = (sample_id // 100) % 3) AS section FROM vplaced GROUP BY ALL),
vlevel AS (SELECT variant, 'document' AS level, document AS r FROM vbest UNION ALL SELECT variant, 'section', section FROM vbest),
vreport AS (SELECT variant, level, CAST(k AS INTEGER) AS k, CAST(count(*) FILTER (r <= k) AS BIGINT) AS hits, (SELECT count(*) FROM q) AS total FROM vlevel, (SELECT unnest([1, 3, 5, 10, 20]) AS k) GROUP BY variant, level, k)"""


def _recalled(spark, sf_dir, *variants):
    ranked = search.rank_variants(rel.section_scores(spark, sf_dir), variants=variants or tuple(search.VARIANTS))
    named = ranked.withColumn("norm_title", text.normalize_title(F.concat(F.lit("Doc label "), F.col("label").cast("string"), F.lit(" (x)"))))
    return flows.evaluate(named, rel.label_truth(spark, sf_dir, "doc label "), 20, ("variant",), doc_rank="doc_place")


@query(f"WITH {_RECALLED} SELECT variant, level, k, hits, total, hits / total AS recall FROM vreport")
def hybrid_rerank_recall(spark, sf_dir):
    return _recalled(spark, sf_dir)


def _recall_of(variant: str) -> None:
    """Registers the recall of one variant's ranking."""

    def run(spark, sf_dir):
        return _recalled(spark, sf_dir, variant).drop("variant")

    run.__name__ = variant if variant.startswith("vision") else f"{variant}_recall"
    query(f"WITH {_RECALLED} SELECT level, k, hits, total, hits / total AS recall FROM vreport WHERE variant = '{variant}'")(run)


for _variant in search.VARIANTS:
    _recall_of(_variant)


@query("""WITH t AS (SELECT vec_id // 8 AS sec, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, 65)) AS d FROM embeddings),
m AS (SELECT sec, d, coalesce(sum(x) FILTER (vec_id % 5 <> 0), 0) / greatest(count(*) FILTER (vec_id % 5 <> 0), 1e-9) AS x FROM t GROUP BY ALL), n AS (SELECT sec, sqrt(sum(x * x)) AS n FROM m GROUP BY sec)
SELECT sec, list(round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) ORDER BY d) AS pooled FROM m JOIN n USING (sec) GROUP BY sec""")
def mean_pool(spark, sf_dir):
    e = rel.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("long").alias("sec"), "vec_id", vectors.doubles("embedding").alias("x"))
    s = e.groupBy("sec").agg(F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias("t"))  # eight of each
    pooled = vectors.mean_pool(F.transform("t", lambda r: r["x"]), F.transform("t", lambda r: r["vec_id"] % 5 != 0))
    return s.select("sec", scores.rounded_each(pooled).alias("pooled"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), u AS (SELECT label, unnest(list_transform(x, lambda y: y / sqrt(list_dot_product(x, x)))) AS y, unnest(range(1, len(x) + 1)) AS d FROM e),
m AS (SELECT label, d, avg(y) AS y FROM u GROUP BY ALL), c AS (SELECT label, list(y ORDER BY d) AS c FROM m GROUP BY label), s AS (SELECT vec_id, e.label AS truth, c.label AS guess, list_dot_product(x, c) / sqrt(list_dot_product(c, c)) AS s FROM e, c),
b AS (SELECT vec_id, truth, guess, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, guess) AS r FROM s)
SELECT vec_id, truth, guess FROM b WHERE r = 1""")
def zero_shot_centroid(spark, sf_dir):
    e = rel.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth"), vectors.doubles("embedding").alias("x"))
    each = e.select("truth", F.posexplode(vectors.l2_normalize("x")).alias("d", "y")).groupBy("truth", "d").agg(F.avg("y").alias("y"))
    classes = each.groupBy("truth").agg(F.sort_array(F.collect_list(F.struct("d", "y"))).alias("c")).select(F.col("truth").alias("guess"), vectors.l2_normalize(F.transform("c", lambda r: r["y"])).alias("c"))
    # One row holds the classes, few by nature, and meets every vector.
    model = classes.agg(F.sort_array(F.collect_list(F.struct("guess", "c"))).alias("classes"))
    scored = e.join(F.broadcast(model)).select("vec_id", "truth", "classes", F.transform("classes", lambda k: vectors.dot("x", k["c"])).alias("s"))
    return scored.select("vec_id", "truth", F.get("classes", metrics.argmax(F.col("s")))["guess"].alias("guess"))


@query(f"""WITH {rel.SCORED}, r AS (SELECT sample_id, vec_pos AS item, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, vec_pos) AS fr FROM scored)
SELECT sample_id, item, round(CASE WHEN fr <= 10 THEN score + (item % 11) / 20.0::DOUBLE ELSE -100 END, 6) AS final FROM r""")
def shortlist_rerank(spark, sf_dir):
    return search.shortlists_of_all(rel.samples(spark, sf_dir), rel.vectors(spark, sf_dir), 10, (F.col("item") % 11) / 20.0, finish=r6)


@query(f"""WITH {rel.SCORED}, i AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, vec_pos DESC) - 1 AS rank, truth = label AS ok FROM scored),
ir AS (SELECT sample_id, min(rank) FILTER (ok) AS rank FROM q LEFT JOIN i USING (sample_id) GROUP BY ALL), t AS (SELECT vec_pos, row_number() OVER (PARTITION BY vec_pos ORDER BY score DESC, sample_id DESC) - 1 AS rank, truth = label AS ok FROM scored),
tr AS (SELECT vec_pos, min(rank) FILTER (ok) AS rank FROM v LEFT JOIN t USING (vec_pos) GROUP BY ALL),
a AS (SELECT {', '.join(f"100.0::DOUBLE * count(*) FILTER (rank < {k}) / count(*) AS txt_r{k}" for k in (1, 5, 10))} FROM ir),
b AS (SELECT {', '.join(f"100.0::DOUBLE * count(*) FILTER (rank < {k}) / count(*) AS img_r{k}" for k in (1, 5, 10))} FROM tr),
m AS (SELECT *, (txt_r1 + txt_r5 + txt_r10) / 3 AS txt_r_mean, (img_r1 + img_r5 + img_r10) / 3 AS img_r_mean FROM a, b)
SELECT {', '.join(f"round({c}, 6) AS {c}" for c in ("txt_r1", "txt_r5", "txt_r10", "img_r1", "img_r5", "img_r10", "txt_r_mean", "img_r_mean"))}, round((txt_r_mean + img_r_mean) / 2, 6) AS r_mean, round(txt_r_mean, 6) AS agg_metrics FROM m""")
def sim_matrix_retrieval(spark, sf_dir):
    images, texts = metrics.retrieval_ranks(rel.samples(spark, sf_dir), rel.vectors(spark, sf_dir))
    out = metrics.retrieval_report(images, texts)
    return out.select(*[r6(c).alias(c) for c in out.columns])


# Graphs of sections


@query(f"WITH {rel.EDGES} SELECT sample_id, i, j, round(weight, 6) AS weight FROM edge")
def relation_edges(spark, sf_dir):
    return graph.relation_edges(graph.average_relations(rel.relations(spark, sf_dir)), **rel.GATES).withColumn("weight", r6("weight"))


@query(f"""WITH {rel.RELATIONS} SELECT sample_id, count(*) FILTER (p_con >= p_neu AND p_con >= p_ent) AS contradiction, count(*) FILTER (p_neu > p_con AND p_neu >= p_ent) AS neutral, count(*) FILTER (p_ent > p_con AND p_ent > p_neu) AS entailment FROM rel GROUP BY sample_id""")
def label_counts(spark, sf_dir):
    return graph.label_counts(graph.average_relations(rel.relations(spark, sf_dir)))


def _graph(spark, sf_dir):
    nodes = rel.candidates(spark, sf_dir)
    return nodes, graph.relation_edges(graph.average_relations(rel.relations(spark, sf_dir, nodes)), **rel.GATES)


_COMPONENTS = rel.EDGES + """,
path0 AS (SELECT sample_id, idx AS a, idx AS b FROM cand UNION SELECT sample_id, i, j FROM edge UNION SELECT sample_id, j, i FROM edge),
path1 AS (SELECT DISTINCT x.sample_id, x.a, y.b FROM path0 x JOIN path0 y ON x.sample_id = y.sample_id AND x.b = y.a), path2 AS (SELECT DISTINCT x.sample_id, x.a, y.b FROM path1 x JOIN path1 y ON x.sample_id = y.sample_id AND x.b = y.a),
path3 AS (SELECT DISTINCT x.sample_id, x.a, y.b FROM path2 x JOIN path2 y ON x.sample_id = y.sample_id AND x.b = y.a)"""


@query(f"WITH {_COMPONENTS} SELECT sample_id, a AS idx, min(b) AS component FROM path3 GROUP BY sample_id, a")
def components(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.components(nodes, edges, rel.M)


_CLIQUES = rel.EDGES + f""",
near AS (SELECT c.sample_id, c.idx, coalesce(bit_or(1 << e.o), 0) AS near FROM cand c LEFT JOIN (SELECT sample_id, i AS n, j AS o FROM edge UNION ALL SELECT sample_id, j, i FROM edge) e ON e.sample_id = c.sample_id AND e.n = c.idx GROUP BY ALL),
mask AS (SELECT sample_id, unnest(range(1, 1 << {rel.M})) AS mask FROM q),
clique AS (SELECT m.sample_id, mask, list(idx ORDER BY idx) AS members FROM mask m JOIN near n ON n.sample_id = m.sample_id AND (mask & (1 << idx)) <> 0 GROUP BY m.sample_id, mask
  HAVING bit_or(mask & ~(near | (1 << idx))) = 0 AND (bit_and(near) & ~mask) = 0)"""


@query(f"WITH {_CLIQUES} SELECT sample_id, members FROM clique")
def maximal_cliques(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.maximal_cliques(nodes, edges, rel.M)


_CLUSTER_STEPS = """
norm AS (SELECT sample_id, idx, (similarity - min(similarity) OVER w) / (max(similarity) OVER w - min(similarity) OVER w) AS norm FROM cand WINDOW w AS (PARTITION BY sample_id)),
sub AS (SELECT c.sample_id, c.mask AS whole, c.members AS clique, s.mask AS sub FROM clique c JOIN mask s ON s.sample_id = c.sample_id AND (s.mask & ~c.mask) = 0 AND bit_count(s.mask) = least(3, bit_count(c.mask))),
sc AS (SELECT s.sample_id, whole, clique, sub, list(idx ORDER BY idx) AS members, avg(norm) AS mean_score FROM sub s JOIN norm n ON n.sample_id = s.sample_id AND (sub & (1 << idx)) <> 0 GROUP BY ALL),
es AS (SELECT sc.*, coalesce((SELECT sum(weight) FROM edge e WHERE e.sample_id = sc.sample_id AND (sub & (1 << i)) <> 0 AND (sub & (1 << j)) <> 0), 0) AS edge_sum FROM sc),
b AS (SELECT *, row_number() OVER (PARTITION BY sample_id, whole ORDER BY round(edge_sum, 9) DESC, round(mean_score, 9) DESC, members) AS r,
  0.7::DOUBLE * mean_score + 0.3::DOUBLE * CASE WHEN len(members) > 1 THEN edge_sum / (len(members) * (len(members) - 1) / 2) ELSE 0 END AS final_score FROM es)"""


@query(f"WITH {_CLIQUES}, {_CLUSTER_STEPS} SELECT sample_id, members, round(edge_sum, 6) AS edge_sum, round(mean_score, 6) AS mean_score, round(final_score, 6) AS final_score FROM b WHERE r = 1")
def clique_clusters(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.clique_clusters(nodes, edges, rel.M).select("sample_id", "members", r6("edge_sum").alias("edge_sum"), r6("mean_score").alias("mean_score"), r6("final_score").alias("final_score"))


# The whole flow: documents by image, sections by blended scores, cliques of agreeing sections, and recall after each.

_FLOW = config.settings(k=20, m=8, expand=60, softmax_temperature=0.5, e_min=0.45)
_FLOW_SQL = rf"""{rel.TITLED},
v AS (SELECT vec_id AS vec_pos, CAST(label AS BIGINT) * 1000000 + vec_id // 30 AS doc_idx, label, vec_id // 30 AS run, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
q AS (SELECT vec_pos AS sample_id, label AS truth, vector FROM v WHERE vec_pos % 100 = 0),
kb AS (SELECT d.doc_idx, d.label, t.lines FROM (SELECT DISTINCT doc_idx, label, run FROM v WHERE run % 7 <> 3) d JOIN titled t ON t.doc_idx = d.run * 10 + d.label),
hit AS (SELECT sample_id, v.doc_idx, vec_pos, list_dot_product(q.vector, v.vector) AS score FROM q JOIN v ON sample_id <> vec_pos SEMI JOIN kb ON kb.doc_idx = v.doc_idx),
hr AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, vec_pos) AS rank FROM hit),
h1 AS (SELECT *, row_number() OVER (PARTITION BY sample_id, doc_idx ORDER BY rank) AS n FROM hr WHERE rank <= 60),
docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rank) AS doc_rank FROM h1 WHERE n = 1) WHERE doc_rank <= 20),
soft AS (SELECT *, exp(score / 0.5) / sum(exp(score / 0.5)) OVER (PARTITION BY sample_id) AS img_norm FROM docs),
sec AS (SELECT s.*, kb.label, i AS section_idx, lines[i + 1] AS t FROM soft s JOIN kb USING (doc_idx), LATERAL (SELECT unnest(range(0, len(lines))) AS i)),
fused AS (SELECT *, 0.3::DOUBLE * img_norm + 0.7::DOUBLE / (1 + exp(-(score * 4 - (length(t) % 7) / 10.0::DOUBLE - section_idx / 1000.0::DOUBLE))) AS combined FROM sec WHERE section_idx % 9 NOT IN (4, 7) AND regexp_matches(t, '\S')),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY combined DESC, doc_rank, section_idx) AS section_rank FROM fused) WHERE section_rank <= 8),
cand AS (SELECT sample_id, CAST(section_rank - 1 AS INTEGER) AS idx, doc_idx, combined AS similarity, length(t) AS n, label, section_idx FROM top),
pair AS (SELECT a.sample_id, a.idx AS i, b.idx AS j, (a.similarity + b.similarity) / 4 + 0.5::DOUBLE AS s, (a.n + b.n) % 5 AS r FROM cand a JOIN cand b ON a.sample_id = b.sample_id AND a.idx < b.idx),
p1 AS (SELECT sample_id, i, j, s * (1 - r * 0.1::DOUBLE) * 0.95::DOUBLE AS p_ent, (1 - s) * r * 0.2::DOUBLE AS p_con FROM pair),
edge AS (SELECT sample_id, i, j, least(1.0::DOUBLE, p_ent - p_con) AS weight FROM p1 WHERE p_ent >= 0.45 AND p_ent - p_con >= 0.15 AND p_ent - p_con >= 0.25),
{_CLIQUES[len(rel.EDGES) + 1:]}, {_CLUSTER_STEPS},
clus AS (SELECT sample_id, members, row_number() OVER (PARTITION BY sample_id ORDER BY final_score DESC, array_to_string(list_transform(clique, lambda x: lpad(CAST(x AS VARCHAR), 3, '0')), ',')) AS cluster_rank, final_score FROM b WHERE r = 1)"""


def _flow(spark, sf_dir):
    """Documents found, sections kept and clusters."""
    kb = rel.knowledge_base(spark, sf_dir)
    found = flows.retrieve(rel.samples(spark, sf_dir), rel.vectors(spark, sf_dir).select("vec_pos", "doc_idx", "vector"), kb, _FLOW)
    rerank = F.col("similarity") * 4 - F.char_length("section_text") % 7 / 10.0 - F.col("section_idx") / 1000.0
    top = flows.fuse(flows.candidates(found, kb).withColumn("rerank_score", rerank), _FLOW).withColumns({"norm_title": text.normalize_title("source_title"), "idx": F.col("idx").cast("int")})
    cands = top.select("sample_id", "idx", F.col("combined_score").alias("similarity"), F.char_length("section_text").alias("n"))
    s = graph.section_pairs(cands).select("sample_id", "i", "j", ((F.col("similarity_i") + F.col("similarity_j")) / 4 + 0.5).alias("s"), ((F.col("n_i") + F.col("n_j")) % 5).alias("r"))
    ent, con = F.col("s") * (1 - F.col("r") * 0.1), (1 - F.col("s")) * F.col("r") * 0.2  # synthetic, no model's output
    relations = s.select("sample_id", "i", "j", ent.alias("ent_ij"), con.alias("con_ij"), (1 - ent - con).alias("neu_ij"), (ent * 0.9).alias("ent_ji"), con.alias("con_ji"), (1 - ent * 0.9 - con).alias("neu_ji"))
    named = found.join(kb.select("doc_idx", text.normalize_title("title").alias("norm_title")), "doc_idx")
    return named, top, flows.cluster(cands, relations, _FLOW, "clique")


@query(f"WITH {_FLOW_SQL} SELECT sample_id, idx, doc_idx, CAST(section_idx AS INTEGER) AS section_idx, round(similarity, 6) AS combined FROM cand")
def flow_sections(spark, sf_dir):
    return _flow(spark, sf_dir)[1].select("sample_id", "idx", "doc_idx", "section_idx", r6("combined_score").alias("combined"))


@query(f"WITH {_FLOW_SQL} SELECT sample_id, CAST(cluster_rank AS INTEGER) AS cluster_rank, members, round(final_score, 6) AS final_score FROM clus")
def flow_clusters(spark, sf_dir):
    return _flow(spark, sf_dir)[2].select("sample_id", "cluster_rank", "members", r6("final_score").alias("final_score"))


@query(f"""WITH {_FLOW_SQL}, seen AS (SELECT 'image' AS stage, sample_id, label, NULL AS section_idx, doc_rank AS rank FROM docs JOIN kb USING (doc_idx) UNION ALL SELECT 'sections', sample_id, label, section_idx, section_rank FROM top
  UNION ALL SELECT 'clusters', c.sample_id, label, section_idx, cluster_rank FROM (SELECT sample_id, cluster_rank, unnest(members) AS idx FROM clus) c JOIN cand ON cand.sample_id = c.sample_id AND cand.idx = c.idx),
best AS (SELECT stage, q.sample_id, min(rank) FILTER (label = truth) AS document, min(rank) FILTER (label = truth AND q.sample_id % 300 <> 0 AND section_idx = (q.sample_id // 100) % 3) AS section FROM seen JOIN q USING (sample_id) GROUP BY ALL),
lev AS (SELECT stage, 'document' AS level, document AS r FROM best UNION ALL SELECT stage, 'section', section FROM best)
SELECT stage, level, CAST(k AS INTEGER) AS k, CAST(count(*) FILTER (r <= k) AS BIGINT) AS hits, (SELECT count(*) FROM q) AS total, count(*) FILTER (r <= k) / (SELECT count(*) FROM q) AS recall FROM lev, {_KS} GROUP BY stage, level, k""")
def evidence_flow(spark, sf_dir):
    found, top, clusters = _flow(spark, sf_dir)
    members = clusters.select("sample_id", "cluster_rank", F.explode("members").alias("idx")).join(top.select("sample_id", "idx", "norm_title", "section_idx"), ["sample_id", "idx"])
    seen = found.select("sample_id", F.lit("image").alias("stage"), "norm_title", F.lit(None).cast("int").alias("section_idx"), F.col("doc_rank").alias("rank"))
    seen = seen.union(top.select("sample_id", F.lit("sections"), "norm_title", "section_idx", "section_rank")).union(members.select("sample_id", F.lit("clusters"), "norm_title", "section_idx", "cluster_rank"))
    return flows.evaluate(seen, rel.label_truth(spark, sf_dir, "things of label "), 20, ("stage",), "rank", "rank")


def _consistent(spark, sf_dir):
    nodes = rel.candidates(spark, sf_dir).withColumn("strength", scores.strength("rerank", "similarity"))
    edges = graph.relation_edges(graph.average_relations(rel.relations(spark, sf_dir, nodes)), clamp=False, e_min=0.0, margin=-1.0, tau=0.2)
    return graph.consistency_clusters(nodes, edges)


# Pruning as a table of steps: for each set of sections (a mask) the one whose removal raises consistency most, if any does, and the one that adds least.
_CONSISTENT = rel.RELATIONS + f""",
edge AS (SELECT sample_id, i, j, greatest(0.0::DOUBLE, p_ent - p_con) AS w FROM rel WHERE greatest(0.0::DOUBLE, p_ent - p_con) >= 0.2),
dirs AS (SELECT sample_id, i AS a, j AS b, w FROM edge UNION ALL SELECT sample_id, j, i, w FROM edge),
path0 AS (SELECT sample_id, idx AS a, idx AS b FROM cand UNION SELECT sample_id, a, b FROM dirs), path1 AS (SELECT DISTINCT x.sample_id, x.a, y.b FROM path0 x JOIN path0 y ON x.sample_id = y.sample_id AND x.b = y.a),
path2 AS (SELECT DISTINCT x.sample_id, x.a, y.b FROM path1 x JOIN path1 y ON x.sample_id = y.sample_id AND x.b = y.a), path3 AS (SELECT DISTINCT x.sample_id, x.a, y.b FROM path2 x JOIN path2 y ON x.sample_id = y.sample_id AND x.b = y.a),
part AS (SELECT sample_id, comp, bit_or(1 << a) AS mask FROM (SELECT sample_id, a, min(b) AS comp FROM path3 GROUP BY ALL) GROUP BY ALL),
mask AS (SELECT sample_id, unnest(range(1, 1 << {rel.M})) AS mask FROM q),
own AS (SELECT m.sample_id, mask, idx, coalesce((SELECT sum(w) FROM dirs e WHERE e.sample_id = m.sample_id AND e.a = idx AND (mask & (1 << b)) <> 0), 0) AS own FROM mask m JOIN cand c ON c.sample_id = m.sample_id AND (mask & (1 << idx)) <> 0),
raw AS (SELECT sample_id, mask, count(*) AS n, sum(own) / 2 AS total, CASE WHEN count(*) > 1 THEN sum(own) / (count(*) * (count(*) - 1)) ELSE 0 END AS raw FROM own GROUP BY ALL),
gain AS (SELECT *, CASE WHEN n > 2 THEN 2 * (total - own) / ((n - 1) * (n - 2)) ELSE 0 END - raw AS gain FROM own JOIN raw USING (sample_id, mask) WHERE n > 3),
step AS (SELECT sample_id, mask, arg_min(idx, (-round(gain, 11), idx)) FILTER (gain > 1e-12) AS first, arg_min(idx, (round(own, 11), idx)) AS second FROM gain GROUP BY ALL)"""


def _pruned_sql(start: str) -> str:
    """Steps from the masks of `start` (sample_id, comp, mask) down to three sections."""
    return f"""(WITH RECURSIVE p AS (SELECT sample_id, comp, mask, true AS rising FROM {start} UNION ALL
  SELECT p.sample_id, comp, p.mask & ~(1 << CASE WHEN rising AND first IS NOT NULL THEN first ELSE second END), rising AND first IS NOT NULL FROM p JOIN step ON step.sample_id = p.sample_id AND step.mask = p.mask)
  SELECT sample_id, comp, arg_min(mask, bit_count(mask)) AS mask FROM p GROUP BY ALL)"""


_CONSISTENT += f""",
kept AS {_pruned_sql('part')},
gone AS (SELECT sample_id, comp, part.mask & ~kept.mask AS mask FROM part JOIN kept USING (sample_id, comp) WHERE part.mask <> kept.mask),
g0 AS (SELECT g.sample_id, comp, idx AS a, idx AS b FROM gone g JOIN cand c ON c.sample_id = g.sample_id AND (mask & (1 << idx)) <> 0 UNION SELECT g.sample_id, comp, a, b FROM gone g JOIN dirs e ON e.sample_id = g.sample_id AND (mask & (1 << a)) <> 0 AND (mask & (1 << b)) <> 0),
g1 AS (SELECT DISTINCT x.sample_id, x.comp, x.a, y.b FROM g0 x JOIN g0 y ON x.sample_id = y.sample_id AND x.comp = y.comp AND x.b = y.a), g2 AS (SELECT DISTINCT x.sample_id, x.comp, x.a, y.b FROM g1 x JOIN g1 y ON x.sample_id = y.sample_id AND x.comp = y.comp AND x.b = y.a),
g3 AS (SELECT sample_id, comp * 100 + min_b AS comp, bit_or(1 << a) AS mask FROM (SELECT sample_id, comp, a, min(b) AS min_b FROM g2 GROUP BY ALL) GROUP BY ALL),
again AS {_pruned_sql('g3')},
found AS (SELECT sample_id, 'kept' AS type, comp, mask FROM kept UNION ALL SELECT sample_id, 'removed', comp, mask FROM again WHERE bit_count(mask) >= 3),
norms AS (SELECT sample_id, idx, CASE WHEN max(rerank) OVER w > min(rerank) OVER w THEN (rerank - min(rerank) OVER w) / (max(rerank) OVER w - min(rerank) OVER w) ELSE 0 END AS norm FROM cand WINDOW w AS (PARTITION BY sample_id)),
mean AS (SELECT f.sample_id, type, f.mask, raw, avg(norm) AS mean, list(idx ORDER BY idx) AS members FROM found f JOIN raw USING (sample_id, mask) JOIN norms n ON n.sample_id = f.sample_id AND (f.mask & (1 << idx)) <> 0 GROUP BY ALL),
scaled AS (SELECT *, CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 0 END AS scaled FROM mean WINDOW w AS (PARTITION BY sample_id)),
clusters AS (SELECT *, 0.5::DOUBLE * scaled + 0.5::DOUBLE * mean AS hybrid, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY 0.5::DOUBLE * scaled + 0.5::DOUBLE * mean DESC) AS INTEGER) AS cluster_rank FROM scaled)"""


@query(f"WITH {_CONSISTENT} SELECT sample_id, cluster_rank, type, members, round(raw, 6) AS consistency_raw, round(scaled, 6) AS consistency_norm, round(mean, 6) AS section_norm_avg, round(hybrid, 6) AS hybrid_score FROM clusters")
def consistency_clusters(spark, sf_dir):
    out = _consistent(spark, sf_dir)
    return out.select("sample_id", "cluster_rank", "type", "members", *[r6(c).alias(c) for c in ("consistency_raw", "consistency_norm", "section_norm_avg", "hybrid_score")])


@query(f"""WITH {_CONSISTENT}, m AS (SELECT sample_id, cluster_rank, unnest(members) AS idx FROM clusters),
best AS (SELECT q.sample_id, min(cluster_rank) FILTER (v.label = q.truth) AS r FROM q LEFT JOIN m USING (sample_id) LEFT JOIN cand c ON c.sample_id = m.sample_id AND c.idx = m.idx LEFT JOIN v ON v.vec_pos = c.vec_pos GROUP BY q.sample_id)
SELECT CAST(k AS INTEGER) AS k, CAST(count(*) FILTER (r <= k) AS BIGINT) AS hits, count(*) AS total, count(*) FILTER (r <= k) / count(*) AS recall FROM best, (SELECT unnest([1, 3, 5]) AS k) GROUP BY k""")
def cluster_recall(spark, sf_dir):
    s, labels = rel.samples(spark, sf_dir), rel.vectors(spark, sf_dir).select("vec_pos", "label")
    each = _consistent(spark, sf_dir).select("sample_id", "cluster_rank", F.explode("members").alias("idx")).join(rel.candidates(spark, sf_dir).select("sample_id", "idx", "vec_pos"), ["sample_id", "idx"])
    ranked = each.join(labels, "vec_pos").join(s.select("sample_id", "truth"), "sample_id")
    return metrics.recall_at(metrics.first_match(ranked, s, F.col("label") == F.col("truth"), "cluster_rank"), "rank", 5)


# Ground truth and answers


_PIPE_TITLES = rel.NORMALIZED.format("x")


@query(rf"""WITH p AS (SELECT doc_id, lang || '|' || source || '||' || lang AS titles, 'http://x/wiki/' || source || '?a|http://x/wiki/Page_' || (doc_id % 50) || '#b' AS urls, (doc_id % 4) || '| x |' || (doc_id % 9) || ' |3.0' AS ids FROM documents),
t AS (SELECT doc_id, ids, list_filter(list_concat(list_transform(string_split(titles, '|'), lambda x: {_PIPE_TITLES}), list_transform(string_split(urls, '|'), lambda x: {rel.NORMALIZED.format("replace(regexp_extract(x, '/wiki/([^#?]*)', 1), '_', ' ')")})), lambda x: x <> '') AS titles FROM p),
d AS (SELECT doc_id, list_filter(titles, lambda x, i: list_position(titles, x) = i) AS titles, list_transform(list_filter(string_split(ids, '|'), lambda x: regexp_matches(trim(x), '^[0-9]+$')), lambda x: CAST(trim(x) AS INTEGER)) AS sections FROM t)
SELECT doc_id, CAST(n AS INTEGER) AS pos, titles[n + 1] AS title, sections[n + 1] AS section_id FROM d, (SELECT unnest(range(0, 10)) AS n) WHERE n < least(len(titles), len(sections))""")
def ground_truth_pairs(spark, sf_dir):
    d = rel.table(spark, sf_dir, "documents")
    titles = F.concat("lang", F.lit("|"), "source", F.lit("||"), "lang")
    urls = F.concat(F.lit("http://x/wiki/"), "source", F.lit("?a|http://x/wiki/Page_"), (F.col("doc_id") % 50).cast("string"), F.lit("#b"))
    ids = F.concat((F.col("doc_id") % 4).cast("string"), F.lit("| x |"), (F.col("doc_id") % 9).cast("string"), F.lit(" |3.0"))
    pairs = metrics.truth_pairs(metrics.truth_titles(titles, urls), metrics.truth_sections(ids))
    return d.select("doc_id", F.posexplode(pairs).alias("pos", "p")).select("doc_id", "pos", "p.title", "p.section_id")


_FIRST = "regexp_extract(answer, '^\\S+')"


@query(f"""WITH {rel.ANSWERS}, e AS (SELECT conv_id, turn, {_answer_sql("regexp_extract(question, '^[^ ]+')")} AS r, {_answer_sql("regexp_extract(answer, '^[^ ]+')")} AS c FROM answers) SELECT conv_id, turn, r = c AS em FROM e WHERE r <> ''""")
def em_single(spark, sf_dir):
    first = lambda c: F.regexp_extract(c, "^[^ ]+", 0)
    a = rel.answers(spark, sf_dir).filter(text.normalize_answer(first("question")) != "")
    return a.select("conv_id", "turn", metrics.exact_match(first("question"), first("answer")).alias("em"))


def _list_sql(parts: str) -> str:
    return f"list_distinct(list_filter(list_transform({parts}, lambda x: {_answer_sql('x')}), lambda x: x <> ''))"


@query(f"""WITH {rel.ANSWERS}, w AS (SELECT conv_id, turn, array_to_string(string_split(question, ' ')[1:4], '&&') AS ref, array_to_string(string_split(question, ' ')[2:5], ' and ') AS cand FROM answers),
e AS (SELECT conv_id, turn, {_list_sql("string_split(ref, '&&')")} AS r, {_list_sql("string_split(replace(replace(cand, ' and ', ','), ' & ', ','), ',')")} AS c FROM w)
SELECT conv_id, turn, len(list_intersect(r, c)) / len(list_distinct(list_concat(r, c))) >= 0.5 AS em FROM e WHERE len(r) > 0""")
def em_multi(spark, sf_dir):
    words = F.split("question", " ")
    a = rel.answers(spark, sf_dir).select("conv_id", "turn", F.array_join(F.slice(words, 1, 4), "&&").alias("ref"), F.array_join(F.slice(words, 2, 4), " and ").alias("cand"))
    some = F.exists(F.split("ref", "&&"), lambda x: text.normalize_answer(x) != "")
    return a.filter(some).select("conv_id", "turn", metrics.list_match("ref", "cand").alias("em"))


# Several annotators: the first word of each of a conversation's turns; the first turn's is the given answer.
def _annotated(spark, sf_dir):
    t = rel.table(spark, sf_dir, "conversations")
    refs = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("answer_id"), F.lower(F.regexp_extract("text", r"^\S+", 0)).alias("answer")))).alias("answers"))
    return refs.select("conv_id", "answers", F.col("answers")[0]["answer"].alias("given"), F.when(F.col("conv_id") % 3 == 0, "templated").otherwise("automatic").alias("question_type"), F.when(F.col("conv_id") % 2 == 0, "other").otherwise("yes/no").alias("answer_type"))


_ANNOTATED = rf"""
ann AS (SELECT conv_id, turn, lower(regexp_extract(text, '^\S+')) AS t FROM conversations),
m AS (SELECT *, {_consensus_punct_sql('t')} AS m FROM ann),
k AS (SELECT conv_id, turn, t, string_split(regexp_replace(replace(m, '.', chr(1)), chr(1) || '(\d)', '.\1', 'g'), chr(1)) AS p FROM m),
x AS (SELECT conv_id, turn, t, {_STOPS} AS x FROM k),
given AS (SELECT conv_id, arg_min({_WORDS}, turn) AS given, arg_min(t, turn) AS raw, count(DISTINCT t) = 1 AS agree FROM x GROUP BY conv_id),
refs AS (SELECT conv_id, turn, given, CASE WHEN agree THEN t ELSE x END AS answer FROM x JOIN given USING (conv_id)),
acc AS (SELECT a.conv_id, avg(least(1.0::DOUBLE, (SELECT count(*) FROM refs o WHERE o.conv_id = a.conv_id AND o.turn <> a.turn AND o.answer = a.given) / 3)) AS accuracy FROM refs a GROUP BY a.conv_id),
typed AS (SELECT conv_id, accuracy, CASE WHEN conv_id % 3 = 0 THEN 'templated' ELSE 'automatic' END AS question_type, CASE WHEN conv_id % 2 = 0 THEN 'other' ELSE 'yes/no' END AS answer_type FROM acc)"""


@query(f"WITH {_ANNOTATED} SELECT conv_id, round(accuracy, 6) AS accuracy FROM acc")
def vqa_consensus(spark, sf_dir):
    return _annotated(spark, sf_dir).select("conv_id", r6(metrics.consensus_accuracy("given", "answers")).alias("accuracy"))


@query(f"""WITH {_ANNOTATED} SELECT 'overall' AS level, 'all' AS name, round(100 * avg(accuracy), 2) AS accuracy, count(*) AS n FROM typed UNION ALL
SELECT 'question_type', question_type, round(100 * avg(accuracy), 2), count(*) FROM typed GROUP BY ALL UNION ALL SELECT 'answer_type', answer_type, round(100 * avg(accuracy), 2), count(*) FROM typed GROUP BY ALL""")
def vqa_report(spark, sf_dir):
    return metrics.consensus_report(_annotated(spark, sf_dir).withColumn("accuracy", metrics.consensus_accuracy("given", "answers")))


@query(r"""WITH a AS (SELECT conv_id, lower(regexp_extract(text, '^\S+')) AS x, turn FROM conversations), g AS (SELECT conv_id, arg_min(x, turn) AS given FROM a GROUP BY conv_id)
SELECT conv_id, round(least(1.0::DOUBLE, count(*) FILTER (x = given) / 3), 6) AS accuracy FROM a JOIN g USING (conv_id) GROUP BY conv_id""")
def aok_accuracy(spark, sf_dir):
    return _annotated(spark, sf_dir).select("conv_id", r6(metrics.direct_accuracy("given", F.transform("answers", lambda a: a["answer"]))).alias("accuracy"))


@query(rf"""WITH {rel.ANSWERS}, s AS (SELECT conv_id, turn, unnest(['q', 'a']) AS side, unnest([question, answer]) AS t FROM answers),
m AS (SELECT *, {_consensus_punct_sql('t')} AS m FROM s),
k AS (SELECT conv_id, turn, side, string_split(regexp_replace(replace(m, '.', chr(1)), chr(1) || '(\d)', '.\1', 'g'), chr(1)) AS p FROM m),
x AS (SELECT conv_id, turn, side, {_STOPS} AS x FROM k), w AS (SELECT conv_id, turn, side, {_WORDS} AS w FROM x)
SELECT count(*) AS n, round(avg((q.w = a.w)::INT), 6) AS accuracy FROM w q JOIN w a ON q.conv_id = a.conv_id AND q.turn = a.turn AND q.side = 'q' AND a.side = 'a'""")
def gqa_accuracy(spark, sf_dir):
    return rel.answers(spark, sf_dir).agg(F.count("*").alias("n"), r6(F.avg(metrics.single_accuracy("answer", "question"))).alias("accuracy"))


@query("""SELECT CAST(count(*) FILTER ((n_chars > 500)::INT = quality) AS BIGINT) AS correct, count(*) AS total, count(*) FILTER ((n_chars > 500)::INT = quality) / count(*) AS accuracy FROM labels JOIN documents USING (doc_id)""")
def class_accuracy(spark, sf_dir):
    both = rel.table(spark, sf_dir, "labels").join(rel.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.class_accuracy(both, (F.col("n_chars") > 500).cast("int"), F.col("quality"))


@query("""WITH a AS (SELECT o_custkey AS sample_id, o_orderpriority AS answer, o_orderkey AS pos FROM orders), c AS (SELECT sample_id, answer, count(*) AS n_seen, min(pos) AS f FROM a GROUP BY ALL),
r AS (SELECT sample_id, answer, n_seen, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY n_seen DESC, f) AS INTEGER) AS place FROM c) SELECT * FROM r WHERE place <= 3""")
def frequent_answers(spark, sf_dir):
    a = rel.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("answer"), F.col("o_orderkey").alias("pos"))
    return search.frequent_first(a, 3)


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '[.\n]+ *'), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, coalesce(list_reduce(list_transform(p, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: contains(y, x[1]))) > 0 THEN kept ELSE list_concat(kept, x) END), []) AS kept FROM s WHERE len(p) > 0
UNION ALL SELECT doc_id, []::VARCHAR[] FROM s WHERE len(p) = 0""")
def caption_dedup(spark, sf_dir):
    d = rel.table(spark, sf_dir, "documents")
    return d.select("doc_id", search.without_contained(F.filter(F.split("text", r"[.\n]+ *"), lambda s: s != "")).alias("kept"))


# Results, telemetry


@query("""WITH s AS (SELECT 0 AS k, conv_id, turn, text FROM conversations WHERE turn % 2 = 1 UNION ALL SELECT 1, conv_id, turn, text FROM conversations WHERE turn % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k, turn) AS n FROM s) SELECT conv_id, turn, text FROM r WHERE n = 1""")
def merge_dedup_results(spark, sf_dir):
    t = rel.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return results.merge_shards([t.filter("turn % 2 = 1"), t.filter("turn % 2 = 0")], "conv_id", "turn")


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS only_a, count(*) FILTER (d.doc_id IS NULL) AS only_b FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def same_ids(spark, sf_dir):
    return results.same_ids(rel.table(spark, sf_dir, "documents"), rel.table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id AS sample_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_samples(spark, sf_dir):
    ids = lambda t: rel.table(spark, sf_dir, t).select(F.col("doc_id").alias("sample_id"))
    return results.missing_samples(ids("documents"), ids("labels"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue FROM r WHERE n <= 6 GROUP BY conv_id""")
def dialogue_window(spark, sf_dir):
    d = results.dialogue(rel.table(spark, sf_dir, "conversations"), 3)
    return d.select("conv_id", "n_turns", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("dialogue"))


@query("SELECT word AS term, list(DISTINCT p_partkey ORDER BY p_partkey) AS items FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY word")
def answer_index(spark, sf_dir):
    return results.inverted_index(rel.table(spark, sf_dir, "part"), "p_partkey", F.split("p_type", " "))


@query(f"""WITH {rel.TELEMETRY}, o AS (SELECT * FROM tele WHERE NOT is_warmup)
SELECT stage, count(*) AS count, round(avg(latency_s), 6) AS latency_mean, round(stddev_pop(latency_s), 6) AS latency_std, round(quantile_cont(latency_s, 0.5), 6) AS latency_p50, round(quantile_cont(latency_s, 0.9), 6) AS latency_p90, round(quantile_cont(latency_s, 0.95), 6) AS latency_p95,
round(quantile_cont(latency_s, 0.99), 6) AS latency_p99, round(avg(peak_vram_gb), 6) AS vram_mean, round(max(peak_vram_gb), 6) AS vram_max, round(avg(energy_j), 6) AS energy_mean, round(sum(energy_j), 4) AS energy_total FROM o GROUP BY stage""")
def stage_summary(spark, sf_dir):
    out = telemetry.stage_summary(rel.telemetry(spark, sf_dir))
    return out.select("stage", "count", *[scores.rounded(c, 4 if c == "energy_total" else 6).alias(c) for c in out.columns[2:]])


@query(f"""WITH {rel.TELEMETRY}, s AS (SELECT user_id AS series_id, t, latency_s AS w, lag(t) OVER p AS t0, lag(latency_s) OVER p AS w0 FROM tele WINDOW p AS (PARTITION BY user_id ORDER BY t))
SELECT series_id, round(sum(coalesce((w0 + w) / 2 * greatest(t - t0, 0), greatest(t - 1704067200, 0) * w)), 2) AS energy_j FROM s GROUP BY series_id""")
def energy_trapezoid(spark, sf_dir):
    s = rel.telemetry(spark, sf_dir).select(F.col("user_id").alias("series_id"), "t", F.col("latency_s").alias("watts"))
    return telemetry.energy(s, since=F.lit(1704067200.0)).withColumn("energy_j", scores.rounded("energy_j", 2))


@query(f"""WITH {rel.TELEMETRY}, n AS (SELECT sample_id, stage, count(*) FILTER (stage <> 'error') OVER (ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tele) SELECT sample_id, stage, coalesce(before, 0) < 5 AS is_warmup FROM n""")
def warmup_flag(spark, sf_dir):
    s = rel.telemetry(spark, sf_dir).select("sample_id", "stage")
    return telemetry.warm_up(s, "sample_id", F.col("stage") != "error", 5)


@query(f"""WITH {rel.TELEMETRY}, w AS (SELECT user_id, sample_id, list(latency_s) OVER l AS xs, avg(latency_s) OVER l AS avg, max(latency_s) OVER l AS max, avg(latency_s) OVER g AS global_avg FROM tele
WINDOW l AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT sample_id, list_sort(xs)[(len(xs) - 1) // 2 + 1] AS median, round(avg, 9) AS avg, max, round(global_avg, 9) AS global_avg FROM w""")
def smoothed_value(spark, sf_dir):
    s = telemetry.smoothed(rel.telemetry(spark, sf_dir), "user_id", ["t"], "latency_s")
    return s.select("sample_id", "median", scores.rounded("avg", 9).alias("avg"), "max", scores.rounded("global_avg", 9).alias("global_avg"))


@query("""WITH m AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS metric FROM orders GROUP BY ALL), b AS (SELECT day, metric, max(metric) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT CAST(day AS VARCHAR) AS day, round(metric, 2) AS metric, before IS NULL OR metric > before AS is_best FROM b""")
def best_checkpoint(spark, sf_dir):
    m = rel.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("metric"))
    return metrics.best_so_far(m, "day", "metric").select(F.col("day").cast("string").alias("day"), scores.rounded("metric", 2).alias("metric"), "is_best")


@query(f"""WITH {rel.TELEMETRY} SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY ALL""")
def stage_windows(spark, sf_dir):
    from ..streaming.telemetry import stage_windows as windows

    e = rel.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("stage"), F.col("value").alias("latency_s"))
    return windows(e).withColumn("mean", r6("mean"))


# Lookups, shortlists and inputs of generators


@query(f"""WITH {rel.CANDIDATES}, s AS (SELECT sample_id, doc_idx, idx, 'title ' || (doc_idx % 5) AS t, vector FROM cand), h AS (SELECT sample_id, 'title ' || (idx % 4) AS t, vector FROM cand WHERE idx < 3),
b AS (SELECT s.sample_id, s.idx, max(list_dot_product(s.vector, h.vector) / sqrt(list_dot_product(s.vector, s.vector)) / sqrt(list_dot_product(h.vector, h.vector))) AS c FROM s JOIN h ON s.sample_id = h.sample_id AND s.t = h.t GROUP BY ALL)
SELECT s.sample_id, s.idx, round(greatest(-1.0::DOUBLE, coalesce(c, -1)), 6) AS similarity FROM s LEFT JOIN b USING (sample_id, idx)""")
def section_similarity(spark, sf_dir):
    c = rel.candidates(spark, sf_dir)
    sections = c.select("sample_id", "doc_idx", F.col("idx").alias("section_idx"), F.concat(F.lit("title "), (F.col("doc_idx") % 5).cast("string")).alias("source_title"), "vector")
    hits = c.filter("idx < 3").select("sample_id", F.concat(F.lit("title "), (F.col("idx") % 4).cast("string")).alias("title"), "vector")
    return search.cosine_by_title(sections, hits).select("sample_id", F.col("section_idx").alias("idx"), r6("similarity").alias("similarity"))


@query("""WITH u AS (SELECT url, min(page_id) AS doc_idx FROM pages GROUP BY url), v AS (SELECT page_id AS vec_pos, CASE WHEN page_id % 4 = 0 THEN 'none' ELSE url END AS url FROM pages)
SELECT vec_pos, coalesce(doc_idx, -1) AS doc_idx FROM v LEFT JOIN u USING (url)""")
def vector_documents(spark, sf_dir):
    from ..sources.readers import url_index
    from ..sources.readers import vector_documents as attach

    p = rel.table(spark, sf_dir, "pages")
    urls = url_index(p.select("url", F.col("page_id").alias("doc_idx")))
    return attach(p.select(F.col("page_id").alias("vec_pos"), F.when(F.col("page_id") % 4 == 0, "none").otherwise(F.col("url")).alias("url")), urls).select("vec_pos", "doc_idx")


@query("""WITH c AS (SELECT CAST(p_size AS BIGINT) AS sample_id, p_partkey AS answer_no, p_name || p_partkey AS answer, p_retailprice AS p, (p_partkey * 7) % 101 AS loss FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, answer_no) AS n FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY loss, answer_no) AS m FROM r WHERE n <= 9)
SELECT sample_id, answer FROM b WHERE m = 1""")
def answer_shortlist(spark, sf_dir):
    c = rel.table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("sample_id"), F.col("p_partkey").alias("answer_no"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("answer"), F.col("p_retailprice").alias("first_prob"), (F.col("p_partkey") * 7 % 101).alias("loss"))
    return search.answer_shortlist(c, 9)


@query("SELECT l_orderkey AS sample_id, l_linenumber AS class_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS INTEGER) AS class_rank FROM lineitem")
def class_ranking(spark, sf_dir):
    losses = rel.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("class_no"), F.col("l_extendedprice").alias("loss"))
    return search.rank_classes(losses).select("sample_id", "class_no", "class_rank")


@query("""SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN embedding[1] WHEN vec_id % 3 = 1 THEN embedding[2] ELSE embedding[3] END::DOUBLE, 6) AS logit FROM embeddings""")
def logit_selection(spark, sf_dir):
    e = rel.table(spark, sf_dir, "embeddings").select("vec_id", F.slice(vectors.doubles("embedding"), F.lit(1), (F.pmod("vec_id", F.lit(3)) + 1).cast("int")).alias("logits"))
    return e.select("vec_id", r6(scores.positive_logit("logits")).alias("logit"))


@query(f"WITH {_TOKENS}, b AS (SELECT qry, sec, list_max(c) AS m FROM prod) SELECT qry, sec, round(m, 6) AS score, CAST(row_number() OVER (PARTITION BY qry ORDER BY m DESC, sec) AS INTEGER) AS rank FROM b")
def image_text_scores(spark, sf_dir):
    e = rel.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("long").alias("sec"), "vec_id", vectors.doubles("embedding").alias("x"))
    s = e.groupBy("sec").agg(F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias("t")).filter(F.size("t") == 8).select("sec", F.transform("t", lambda r: r["x"]).alias("t"))
    q = s.filter("sec % 100 = 0").select(F.col("sec").alias("qry"), F.slice("t", 1, 4).alias("q"))
    scored = search.against_all(q, s.select("sec", F.get("t", F.lit(0)).alias("v")), "qry", F.col("qry") != F.col("sec")).select("qry", "sec", vectors.token_max("q", "v").alias("score"))
    return scored.withColumn("rank", search.rank_by("qry", F.desc("score"), F.asc("sec"))).withColumn("score", r6("score"))


@query(r"""SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS html FROM pages""")
def whitespace_clean(spark, sf_dir):
    return rel.table(spark, sf_dir, "pages").select("page_id", prompts.whitespace_clean("html").alias("html"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS prompt FROM documents")
def evidence_prompt(spark, sf_dir):
    return rel.table(spark, sf_dir, "documents").select("doc_id", prompts.evidence_prompt(F.split("text", "\n")).alias("prompt"))


@query(f"""WITH {rel.ANSWERS} SELECT conv_id, turn, 'Question: ' || question || chr(10) || 'Context: ' || array_to_string(string_split(answer, chr(10))[1:3], chr(10)) || chr(10) || 'Answer with a short entity only.' AS prompt FROM answers""")
def answer_prompt(spark, sf_dir):
    return rel.answers(spark, sf_dir).select("conv_id", "turn", prompts.answer_prompt("question", F.split("answer", "\n")).alias("prompt"))


@query(r"""WITH c AS (SELECT doc_id, lang AS q, string_split(text, chr(10)) AS l FROM documents), g AS (SELECT doc_id, q, l, unnest([2, 4, 5]) AS past, unnest([0, 2, 4]) AS start FROM c)
SELECT doc_id, CAST(past // 2 AS BIGINT) AS part, q || ' \n ' || trim(lower(array_to_string(list_transform(l[start + 1:past], lambda x: trim(x) || '. '), ''))) AS input FROM g WHERE len(l) >= past""")
def fid_inputs(spark, sf_dir):
    d = rel.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(prompts.fid_inputs("lang", F.split("text", "\n"), 5, 2)).alias("k", "input"))
    return d.select("doc_id", F.least(F.col("k") + 1, F.lit(2)).cast("long").alias("part"), "input")


@query("SELECT conv_id, 'Question:' || arg_max(text, turn) || chr(10) || 'Answer:yes' || chr(10) || 'Question:Is this a toilet?' || chr(10) || 'Answer:no' || chr(10) AS prompt FROM conversations GROUP BY conv_id")
def task_prompt(spark, sf_dir):
    t = rel.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array(F.max_by("text", "turn")).alias("questions"))
    return t.select("conv_id", prompts.task_prompt("questions").alias("prompt"))


@query("""WITH e AS (SELECT unnest(range(0, 20)) AS epoch)
SELECT CAST(epoch AS BIGINT) AS epoch, round((1e-4::DOUBLE - 1e-6::DOUBLE) * 0.5 * (1 + cos(pi() * epoch / 20)) + 1e-6::DOUBLE, 12) AS cosine, round(greatest(1e-6::DOUBLE, 1e-4::DOUBLE * pow(0.9::DOUBLE, epoch)), 12) AS step,
round(least(1e-4::DOUBLE, 1e-6::DOUBLE + (1e-4::DOUBLE - 1e-6::DOUBLE) * epoch / 5), 12) AS warmup FROM e""")
def learning_rates(spark, sf_dir):
    steps = spark.range(20).select(F.col("id").alias("epoch"))
    for kind, extra in (("cosine", {}), ("step", {"decay": 0.9}), ("warmup", {"warm_steps": 5, "warm_start": 1e-6})):
        steps = telemetry.learning_rates(steps, "epoch", kind, 1e-4, 1e-6, 20, **extra).withColumn(kind, scores.rounded("lr", 12)).drop("lr")
    return steps


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2')")
def filter_annotations(spark, sf_dir):
    return results.filter_any(rel.table(spark, sf_dir, "documents"), lang=["de", "fr"], source=["src1", "src2"], doc_id=[]).select("doc_id", "lang")


@query("SELECT round(avg(value), 9) AS loss, count(value) AS n FROM events")
def mean_loss(spark, sf_dir):
    out = metrics.mean_loss(rel.table(spark, sf_dir, "events"), "value")
    return out.select(scores.rounded("loss", 9).alias("loss"), "n")


#: Candidate and references: an assistant's turn, the user's, and the user's last line first.
_CAPTIONS = r"""
cap AS (SELECT conv_id, turn, lower(answer) AS c, [lower(question), lower(string_split(answer, chr(10))[-1])] AS rs FROM answers),
side AS (SELECT conv_id, turn, s, list_filter(string_split_regex(x, '\s+'), lambda w: w <> '') AS w FROM (SELECT conv_id, turn, unnest([-1, 0, 1]) AS s, unnest([c, rs[1], rs[2]]) AS x FROM cap)),
gram AS (SELECT conv_id, turn, s, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM side, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n),
tf AS (SELECT conv_id, turn, s, n, g, count(*) AS tf FROM gram GROUP BY ALL)"""


def _captions(spark, sf_dir):
    last = F.lower(F.element_at(F.split("answer", "\n"), -1))
    return rel.answers(spark, sf_dir).select(F.struct("conv_id", "turn").alias("id"), F.lower("answer").alias("candidate"), F.array(F.lower("question"), last).alias("references"))


@query(f"""WITH {rel.ANSWERS}, {_CAPTIONS},
top AS (SELECT conv_id, turn, n, g, max(tf) AS most FROM tf WHERE s >= 0 GROUP BY ALL),
m AS (SELECT a.n, sum(least(a.tf, coalesce(most, 0))) AS m, sum(a.tf) AS t FROM tf a LEFT JOIN top b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.n = b.n AND a.g = b.g WHERE s = -1 GROUP BY a.n),
near AS (SELECT a.conv_id, a.turn, len(a.w) AS c, arg_min(len(b.w), (abs(len(b.w) - len(a.w)), len(b.w))) AS r FROM side a JOIN side b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.s = -1 AND b.s >= 0 GROUP BY a.conv_id, a.turn, len(a.w)),
bp AS (SELECT CASE WHEN sum(c) >= sum(r) THEN 1.0::DOUBLE ELSE exp(1 - sum(r) / sum(c)) END AS bp FROM near),
p AS (SELECT k, CASE WHEN min(m) = 0 THEN 0 ELSE exp(avg(ln(m / t))) END AS p FROM m, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE n <= k GROUP BY k)
SELECT {', '.join(f"round(max(bp * p) FILTER (k = {k}), 6) AS bleu_{k}" for k in (1, 2, 3, 4))} FROM p, bp""")
def caption_bleu(spark, sf_dir):
    out = metrics.bleu4(_captions(spark, sf_dir))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"""WITH {rel.ANSWERS}, {_CAPTIONS},
seen AS (SELECT n, g, count(DISTINCT (conv_id, turn)) AS df FROM tf WHERE s >= 0 GROUP BY ALL),
w AS (SELECT tf.*, tf * (ln((SELECT count(*) FROM cap)::DOUBLE) - ln(coalesce(df, 1)::DOUBLE)) AS w FROM tf LEFT JOIN seen USING (n, g)),
norm AS (SELECT conv_id, turn, s, n, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dots AS (SELECT a.conv_id, a.turn, b.s, a.n, sum(least(a.w, b.w) * b.w) AS dot FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.n = b.n AND a.g = b.g AND a.s = -1 AND b.s >= 0 GROUP BY ALL),
sims AS (SELECT d.conv_id, d.turn, d.s, sum(CASE WHEN c.norm <> 0 AND r.norm <> 0 THEN dot / (c.norm * r.norm) ELSE 0 END) AS sim FROM dots d JOIN norm c ON c.conv_id = d.conv_id AND c.turn = d.turn AND c.s = -1 AND c.n = d.n
  JOIN norm r ON r.conv_id = d.conv_id AND r.turn = d.turn AND r.s = d.s AND r.n = d.n GROUP BY ALL),
pen AS (SELECT a.conv_id, a.turn, b.s, exp(-pow(greatest(len(a.w) - 1, 0) - greatest(len(b.w) - 1, 0), 2) / 72.0::DOUBLE) AS pen FROM side a JOIN side b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.s = -1 AND b.s >= 0)
SELECT conv_id, turn, round(10 * avg(coalesce(sim, 0) * pen) / 4, 6) AS cider FROM pen LEFT JOIN sims USING (conv_id, turn, s) GROUP BY conv_id, turn""")
def caption_cider(spark, sf_dir):
    return metrics.cider(_captions(spark, sf_dir)).select("id.conv_id", "id.turn", r6("cider").alias("cider"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, list_transform(range(1, least(4, 2 + vec_id % 5) + 1), lambda i: [round(x[i], 6), round(x[i + 10], 6), label::DOUBLE]) AS frames FROM e""")
def feature_concat(spark, sf_dir):
    e = rel.table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.doubles("embedding").alias("x"))
    first = F.transform(F.slice("x", 1, 4), lambda v: F.array(scores.rounded(v)))
    second = F.transform(F.slice(F.col("x"), F.lit(11), (F.lit(2) + F.col("vec_id") % 5).cast("int")), lambda v: F.array(scores.rounded(v)))
    third = F.transform(F.slice("x", 1, 9), lambda v: F.array(F.col("label").cast("double")))
    return e.select("vec_id", prompts.concat_features([first, second, third]).alias("frames"))
