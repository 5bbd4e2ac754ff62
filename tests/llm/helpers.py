"""Small tables for the text operators, among them the odd ones that every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.IntegerType())])


def documents(spark, texts, lang=None, ids=None):
    rows = [(k if ids is None else ids[k], t, lang[k] if lang else "en", f"src{k % 3}", len(t) if t is not None else None)
            for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Null and empty values, blanks, a very long text, repeated rows, and columns whose names clash with internal ones."""
    long = "word " * 20_000 + "x" * 5_000
    texts = [None, "", "   \n\t ", "a", long, "same text here now", "same text here now", "Ünïcode ½   日本", "\x00 \x7f"]
    docs = documents(spark, texts, lang=["en", None, "fr", "en", "en", "en", "en", "de", "en"])
    docs = docs.unionByName(docs.filter("doc_id = 5"))
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "no id at all", "en", None, 12)], DOCS)
    both = docs.unionByName(nulls)
    for name in ("block", "row", "fp", "component_id", "label", "score", "n", "word", "path", "value", "key"):
        both = both.selectExpr("*", f"'clash' AS {name}")
    return both


def empty(spark):
    return odd(spark).limit(0)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
