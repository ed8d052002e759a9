"""Reading knowledge bases, questions, indexes and annotations."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_ids, url_to_title

DOCUMENT = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("url", T.StringType()), T.StructField("wikipedia_url", T.StringType()), T.StructField("source_url", T.StringType()),
    T.StructField("wikipedia_title", T.StringType()), T.StructField("section_titles", T.ArrayType(T.StringType())), T.StructField("section_texts", T.ArrayType(T.StringType())),
    T.StructField("image_urls", T.ArrayType(T.StringType())), T.StructField("image_reference_descriptions", T.ArrayType(T.StringType())),
])
KB_COLUMNS = ("doc_idx", "url", "title", "section_titles", "section_texts", "image_urls", "image_reference_descriptions")
QUESTION_COLUMNS = ("question", "answer", "dataset_name", "dataset_image_ids", "wikipedia_title", "wikipedia_url", "evidence_section_id", "question_type")
ANNOTATION = T.StructType([T.StructField("annotations", T.ArrayType(T.StructType([
    T.StructField("question_id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("question_type", T.StringType()), T.StructField("answer_type", T.StringType()),
    T.StructField("answers", T.ArrayType(T.StructType([T.StructField("answer_id", T.LongType()), T.StructField("answer", T.StringType())]))),
])))])


def _present(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with a gapless number from 0 in file order: the place in a partition and the
    rows of the partitions before it, of which there is one count each."""
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["count"]
    known = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, start long"))
    return placed.withColumn("part", part).join(known, "part").select((F.col("start") + within).alias(name), *rows.columns)


def knowledge_base(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """doc_idx, url, title and lists of a JSON file: a list of documents, or an object of documents by URL.

    With lines, each line is a document of a list: such files are read in parts, by
    many tasks, where a list or object is one value and must fit one.

    A list's document has the first URL of url, wikipedia_url, source_url that is not
    empty, and the title wikipedia_title or "unknown" where it has none. An object's
    key is the URL, and a blank title comes from it. Anything else is an error.
    """
    if lines:
        return _listed(numbered(spark.read.schema(DOCUMENT).json(path), "doc_idx"))
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
    kind = F.substring(F.regexp_replace("json", r"(?U)^\s+", ""), 1, 1)
    bad = raw.filter(~F.coalesce(kind.isin("[", "{"), F.lit(False))).limit(1).count()
    if bad:
        raise ValueError("a knowledge base is a JSON list or object")
    listed = raw.filter(kind == "[").select(F.posexplode(F.from_json("json", T.ArrayType(DOCUMENT))).alias("doc_idx", "d")).select("doc_idx", "d.*")
    keyed = raw.filter(kind == "{").select(F.posexplode(F.map_entries(F.from_json("json", T.MapType(T.StringType(), DOCUMENT)))).alias("doc_idx", "e")).select("doc_idx", F.col("e.key").alias("key"), "e.value.*")
    keyed = keyed.withColumn("title", F.coalesce(_present("title"), F.nullif(url_to_title("key"), F.lit("")), _present("wikipedia_title"), F.lit("unknown"))).withColumn("url", F.col("key")).drop("key")
    return _listed(listed).unionByName(keyed.select(*KB_COLUMNS).withColumn("doc_idx", F.col("doc_idx").cast("long")))


def _listed(docs: DataFrame) -> DataFrame:
    url = F.coalesce(_present("url"), _present("wikipedia_url"), _present("source_url"))
    title = F.coalesce(_present("title"), _present("wikipedia_title"), F.lit("unknown"))
    return docs.withColumns({"url": url, "title": title, "doc_idx": F.col("doc_idx").cast("long")}).select(*KB_COLUMNS)


def url_index(kb: DataFrame) -> DataFrame:
    """(url, doc_idx): the first document of each URL."""
    return kb.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("doc_idx").alias("doc_idx"))


def vector_documents(vectors: DataFrame, urls: DataFrame) -> DataFrame:
    """vectors (vec_pos, url, ...) with doc_idx; one that no document has is -1."""
    return vectors.join(urls, "url", "left").withColumn("doc_idx", F.coalesce("doc_idx", F.lit(-1).cast("long")))


def require_documents(vectors: DataFrame, n_documents: int) -> DataFrame:
    """vectors; a doc_idx below 0 or past the knowledge base is an error when the row is read."""
    ok = (F.col("doc_idx") >= 0) & (F.col("doc_idx") < n_documents)
    return vectors.withColumn("doc_idx", F.when(ok, F.col("doc_idx")).otherwise(F.raise_error(F.lit("a vector's document is not in the knowledge base")).cast("long")))


def questions(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows start to end of a CSV of questions, row_idx counting from the file's first; all columns are strings.

    Rows without an image id are left out; blank cells are empty strings.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    named = numbered(rows, "row_idx")
    cut = named.filter((F.col("row_idx") >= start) & (F.col("row_idx") < end if end is not None else F.lit(True)))
    blank = cut.select("row_idx", *[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])
    return blank.withColumn("image_ids", parse_ids("dataset_image_ids")).filter(F.size("image_ids") > 0)


def id_names(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, name) of JSON objects; the later file counts where several have an id."""
    out = None
    for k, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("id", "name"), F.lit(k).alias("ord"))
        out = one if out is None else out.union(one)
    return out.groupBy("id").agg(F.max_by("name", "ord").alias("name"))


def image_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """(id, path) of image files whose name is a number; of several the greatest path. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.regexp_extract("path", r"(?i)/([0-9]+)\.(" + "|".join(extensions) + r")$", 1)
    return found.select(name.alias("id"), "path").filter("id <> ''").groupBy("id").agg(F.max("path").alias("path"))


def resolve_images(wanted: DataFrame, *places: DataFrame) -> DataFrame:
    """wanted (sample_id, id) with path: that of the first place, (id, path), which has the id."""
    out = wanted
    for k, place in enumerate(places):
        out = out.join(place.select("id", F.col("path").alias(f"path_{k}")), "id", "left")
    return out.select(*wanted.columns, F.coalesce(*[F.col(f"path_{k}") for k in range(len(places))]).alias("path"))


def landmark_path(root: str, image_id: Column) -> Column:
    """Nested folders by the first three characters; ids of fewer have no path."""
    part = lambda i: F.substring(image_id, i, 1)
    return F.when(F.length(image_id) >= 3, F.concat_ws("/", F.lit(root), part(1), part(2), part(3), F.concat(image_id, F.lit(".jpg"))))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """A row for each annotated question."""
    return spark.read.schema(ANNOTATION).json(path, multiLine=True).select(F.explode("annotations").alias("a")).select("a.*")


def records(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """txt, json, jsonl, csv, parquet or orc by the path's ending; anything else is an error."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "txt":
        return spark.read.text(path)
    if kind in ("json", "jsonl"):
        return reader.json(path, multiLine=kind == "json")
    if kind == "csv":
        return reader.csv(path, header=True)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    raise ValueError(f"no reader for {kind}")


def mixed(sources: list[DataFrame], ratios: list[float] | None = None, seed: int = 0) -> DataFrame:
    """Sources one after the other, or sampled by ratio each."""
    out = None
    for k, s in enumerate(sources):
        part = s if ratios is None else s.sample(fraction=min(1.0, ratios[k]), seed=seed + k)
        out = part if out is None else out.unionByName(part)
    return out


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, values) of .npy files of one or two dimensions: a row for each row, one for a vector. Objects are refused, as they may run code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.atleast_2d(np.load(io.BytesIO(data.as_py()), allow_pickle=False)).astype(np.float64)
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["path", "row", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row long, values array<double>")


def image_bytes(spark: SparkSession, wanted: DataFrame, folder: str, blank: bytes = b"", listed: int = 10_000) -> DataFrame:
    """wanted (sample_id, path) with content; a path that cannot be read has the blank image.

    The folder is listed first, without contents; up to `listed` files that are both
    there and wanted are read by name, and only of more is the whole folder read.
    """
    files = lambda where: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)
    plain = F.regexp_replace("path", "^file:/*", "/")
    there = files(folder).select(F.col("path").alias("file"), plain.alias("path")).join(wanted.select("path").distinct(), "path", "left_semi")
    names = [r.file for r in there.select("file").limit(listed + 1).collect()]
    if not names:
        return wanted.withColumn("content", F.lit(bytearray(blank)))
    found = files(names if len(names) <= listed else folder).select(plain.alias("path"), "content")
    return wanted.join(found, "path", "left").withColumn("content", F.coalesce("content", F.lit(bytearray(blank))))
