import zlib

import pandas as pd
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns whose names the operators use."""
    rows = [
        (1, None, "en", "src0"), (2, "", "en", None), (3, "   \n\t", None, "src1"), (4, "one two", "en", "src1"), (4, "one two", "en", "src1"),
        (5, "x" * 70_000, "de", "src2"), (6, "the same words come again and again in this text " * 400, "en", "src0"),
        (None, "a row without a number has words too", "en", "src0"), (7, "\u2581 \u00e9\u00df \U0001f600 <|endoftext|> a\x00b  c ", "fr", "srcx"),
        (8, "the same words come again and again in this text " * 400, "en", "src0"), (9, "one two", None, None), (10, "1234 5678 !!", "es", "src3"),
    ]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    return frame.selectExpr("*", "'x' AS ids", "1 AS n", "'y' AS rejected", "2 AS score", "3 AS root", "4 AS shard", "5 AS kept", "6 AS _mix_at_")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def docs_pd(docs):
    return docs.toPandas()


def held_out(i) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


def by_id(df) -> pd.DataFrame:
    return df.toPandas().sort_values("doc_id").reset_index(drop=True)
