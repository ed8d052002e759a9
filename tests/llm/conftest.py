import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]); with extra=True, also columns whose names could clash."""

    def build(rows, extra=False):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None)[:5] for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("id", "words", "h", "n", "k", "text_h", "fp", "size", "shard", "held", "pos", "rows", "part", "root", "batch", "label"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return build


#: Nulls, empty and blank texts, one word, repeated rows, equal texts, a null id, a long text, text of other scripts.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "the cat sat on the mat and the dog sat on the log"), (5, "the cat sat on the mat and the dog sat on the log"),
    (6, "the cat sat on the mat and the dog sat on the log"), (None, "no id here at all"), (7, "long word " * 6000), (8, "日本語のテキスト 😀 Ünïcode É ñ"), (9, "x" * 3000), (10, "a\x00b c"), (None, None), (11, "12345 !!! ###"),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
