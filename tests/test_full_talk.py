from orgweft.catalog import QUERIES
from orgweft.catalog.views import Views
from orgweft.operators import graph as G


def _tables(spark, folder) -> str:
    """Ten people, one conversation (37) of three turns."""
    people = [(k, f"Supplier#{k}", k % 3, 100.0 * k) for k in range(10)]
    spark.createDataFrame(people, "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE").write.parquet(
        f"{folder}/supplier.parquet"
    )
    turns = [(37, turn, "user", "hello") for turn in range(3)]
    spark.createDataFrame(turns, "conv_id BIGINT, turn INT, role STRING, text STRING").write.parquet(
        f"{folder}/conversations.parquet"
    )
    return str(folder)


def test_every_message_mentions_its_conversation_and_its_turn(spark, tmp_path):
    folder = _tables(spark, tmp_path)
    arcs = {tuple(r) for r in QUERIES["communication_graph"](spark, folder).collect()}
    for turn in range(3):
        author = (37 * 7 + turn) % 10
        for other in {37 % 10, turn, (author - 1) % 10} - {author}:
            assert (f"person:s{author}", f"person:s{other}") in arcs and (f"person:s{other}", f"person:s{author}") in arcs
    plain = {(r[0], r[1]) for r in Views(spark, folder).chat_edges.select("source_key", "target_key").collect()}
    assert plain < arcs


def test_blocks_of_sources_change_no_result(spark, tmp_path, monkeypatch):
    folder = _tables(spark, tmp_path)
    names = ("betweenness_exact", "max_len_sweep", "topk_overlap")
    whole = {name: sorted(map(tuple, QUERIES[name](spark, folder).collect())) for name in names}
    walks = []
    walk = G._walk
    monkeypatch.setattr(G, "_walk", lambda *args, **kw: walks.append(1) or walk(*args, **kw))
    monkeypatch.setattr(G, "BLOCK_ROWS", 60)
    for name in names:
        walks.clear()
        assert sorted(map(tuple, QUERIES[name](spark, folder).collect())) == whole[name]
        assert len(walks) > 1, name
