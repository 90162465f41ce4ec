"""A load prepared once and its batches."""

from pyspark.sql import functions as F

from orgweft.plans.bundle import canonicalize
from orgweft.plans.corpus import synthetic_org
from orgweft.plans.load import load, node_rows, prepare_load, with_batches
from orgweft.session import Scratch


def test_a_prepared_load_is_loaded_again_as_it_is(spark, tmp_path):
    records, _contracts = synthetic_org(spark, people=60, modules=38, teams=1)
    base = canonicalize(records, "d")
    one = F.lit(1.0)
    odd = base.nodes.withColumn("props", F.col("props").withField("criticality", one).withField("name", F.lit('a"\\é')))
    values = F.map_entries(F.from_json(F.to_json("props"), "map<string, variant>"))
    texts = F.array_sort(F.transform(values, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.to_json(e["value"]))))
    expected = {r["id"]: r["x"] for r in odd.select("id", texts.alias("x")).collect()}
    got = {r["id"]: r["properties"] for r in node_rows(odd, "d").collect()}
    own = lambda x: x.startswith(('"confidence":', '"evidence_class":'))
    for key, text in got.items():
        rest = [x for x in expected[key] if not own(x)]
        assert '"criticality":1' in rest and all(x in text for x in rest)
        assert text == "{" + ",".join(sorted([*rest, '"confidence":100', '"evidence_class":"observed"'])) + "}"
    # No row is moved to a task of its shape.
    numbered = with_batches(node_rows(base.nodes, "d"), 20)
    assert "rightHint=(strategy=broadcast)" in numbered._jdf.queryExecution().optimizedPlan().toString()
    with Scratch(spark) as shelf:
        ready = prepare_load(base, shelf, 20)
        target = str(tmp_path / "t")
        first = load(base, "s", target, prepared=ready)
        again = load(base, "s", target, prepared=ready)
    whole = load(base, "s", target, size=20)
    assert first["resumed_batches"] == 0
    assert again["resumed_batches"] == whole["resumed_batches"] == first["attempted_batches"] > 0
