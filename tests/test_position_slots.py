"""Slots of covered positions as bits."""

import numpy as np
from pyspark.ml.functions import vector_to_array

from voxloom.operators import glossary as G


def test_position_slots_are_combined_before_the_shuffle(spark, capsys):
    texts = ["uno dos tres", " ".join(["x"] * 125 + ["dos"]), "nada", None]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, Review string")
    terms = spark.createDataFrame([("uno dos",), ("dos",)], "Term string")
    got = G.position_vector(df, terms, 120)
    slots = {r["review_id"]: np.flatnonzero(r["v"]).tolist() for r in got.select(
        "review_id", vector_to_array("rp_vector").alias("v")).collect()}
    assert slots == {0: [0, 1], 1: [5], 2: [], 3: []}
    got.explain()
    assert "collect_set" not in capsys.readouterr().out
