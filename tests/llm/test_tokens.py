from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from docketry.llm import tokens

PATH = f"{tokens.FOLDER}/{tokens.VOCABULARY}"


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
def test_sizes_and_round_trip(spark):
    own = tokens.encoding(PATH)
    texts = ["Storm water, 1,234 gal. — señora", "", "x" * 3000, "  \n\n a"]
    assert all(own.decode(own.encode_ordinary(t)) == t for t in texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").withColumn("text", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    got = {r["i"]: r["n_tokens"] for r in tokens.sized(df, "t").collect()}
    assert got == {i: len(own.encode_ordinary(t)) for i, t in enumerate(texts)}
