import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use inside or add.
CLASHING = ["__d", "__t", "__kept", "__score", "__ids", "__text", "__n_lines", "d", "t", "x", "key", "size", "target", "id", "component", "c0", "c1"]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text) or (doc_id, text, source) to a documents table."""

    def make(rows, clashing=False):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", *[f"cast(doc_id as string) as `{c}`" for c in CLASHING]) if clashing else df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, repeated rows, ties, a long text, characters of several bytes."""
    line = "the same long line that many documents hold, over and over again"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (None, "a null id " + line), (5, f"x\n{line}\ny"), (5, f"x\n{line}\ny"), (6, f"{line}\nÉÈ ß ñ \U0001f600 end"), (7, line), (8, f" {line.upper()} "), (9, f"{line}\r\n{line}"), (10, "word " * 40000), (-3, "two words"), (11, None), (12, f"{line} and a tail")]
    return [(*r, s) for r, s in zip(rows, ["a", "b", None, "a", "c", "c", "c", "a", "b", "a", None, "a", "b", "c", "d"])]
