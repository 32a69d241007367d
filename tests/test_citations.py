"""All citations of a unified requirement reach the run folder and traceability."""

from functools import partial

from voxloom.catalog.learning import length_model, letter_encoder
from voxloom.operators import consolidate as C
from voxloom.operators import requirements as Q
from voxloom.plans import end_to_end

REQUIREMENT = "requirement_no long, type string, nfr_type string, description string, based_on_comments string"


def test_traceability_takes_all_citations(spark):
    ids = ", ".join(str(i) for i in range(1, 26))
    rows = [(1, "FUNCTIONAL", "", "The player shall do it", ids)]
    unified, citations = C.consolidate_tables(
        spark.createDataFrame(rows, REQUIREMENT), listed_ids=10
    )
    clustered = spark.createDataFrame(
        [(i, f"review {i}", 0) for i in range(1, 21)], "ID long, Review string, Cluster int"
    )
    traced = Q.traceability(unified, clustered, citations).collect()
    assert sorted(r["ID"] for r in traced) == list(range(1, 26))
    lost = Q.dangling_citations(unified, clustered, citations).collect()
    assert sorted(r["ID"] for r in lost) == list(range(21, 26))


def test_run_folder_has_all_citations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(
        end_to_end, "consolidate_tables", partial(C.consolidate_tables, listed_ids=1)
    )

    def responder():
        return lambda prompt: "**FR001:** The player shall keep a queue. (Based on comments: 1, 2, 3)"

    texts = [("a" * i + " e" * (i % 3) + " words of it " * 5)[: 51 + i] for i in range(20)]
    reviews = spark.createDataFrame(list(enumerate(texts)), "review_id long, Review string")
    end_to_end.mine_requirements(
        reviews, "an app", responder, length_model, letter_encoder, k_min=3, k_max=3,
        output=str(tmp_path),
    )
    (folder,) = tmp_path.glob("run_id=*")
    unified = spark.read.option("header", True).csv(f"{folder}/unified_requirements.csv")
    assert [r["based_on_comments"] for r in unified.collect()] == ["1"]
    cited = spark.read.option("header", True).csv(f"{folder}/requirement_citations.csv")
    assert sorted(r["ID"] for r in cited.collect()) == ["1", "2", "3"]
