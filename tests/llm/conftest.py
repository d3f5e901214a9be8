import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Columns of no meaning whose names operators use themselves.
    T.StructField("size", T.StringType()), T.StructField("row", T.StringType()), T.StructField("node", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("a.b", T.StringType()),
])

PROSE = (
    "The quiet river runs past the old mill and the stone bridge. Children play there in summer, and in winter the water freezes. "
    "Nobody knows who built the bridge, but every autumn a painter comes to draw it, sitting on the same wooden chair as before.\n"
    "When the painter leaves, the village is silent again and only the miller's dog barks at the wind until the evening comes."
)
LONG = " ".join(f"word{i % 997} of{i % 89} line{i}" for i in range(40_000)) + "."


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), "x", "y", "z", "t", "k", "dot")


MESSY = [
    row(1, PROSE), row(1, PROSE), row(2, None), row(3, ""), row(4, " \n\t "), row(5, LONG, source="b"), row(6, PROSE.replace("river", "stream"), lang=None),
    row(7, "short text", source=None), row(None, PROSE + " More words at the end of it."), row(8, "été à l'école où l'on apprend", lang="fr", source=None),
    row(9, "123 456 !!! ???"), row(10, PROSE, source="b"), row(11, PROSE.upper()), row(1, "another text under the same id"),
]


@pytest.fixture()
def messy(spark):
    return spark.createDataFrame(MESSY, DOC)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DOC)
