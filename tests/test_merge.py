import itertools

import pytest
from conftest import run_plan_text
from pyspark.sql import functions as F

from tessella.errors import DisconnectedTables, KeyTypeMismatch, NoRows, UnsupportedColumn
from tessella.operators.merge import Link, merge_graph, merge_two, merged_names, replay


@pytest.fixture
def shop(spark):
    return {
        "lines": spark.createDataFrame([(1, 1, 10, "l1"), (1, 2, 11, "l2"), (2, 1, 10, "l3"), (9, 1, 10, "l4")], "order_no int, line_no int, part int, note string"),
        "orders": spark.createDataFrame([(1, "c1", "o1"), (2, "c2", "o2")], "order_id long, customer string, note string"),
        "customers": spark.createDataFrame([("c1", 7), ("c2", 8), ("c3", 9)], "customer string, nation int"),
    }


CHAIN = [Link.of("lines", "orders", ("order_no", "order_id")), Link.of("orders", "customers", ("customer", "customer"))]


def values(df):
    return sorted(tuple(sorted(map(str, r))) for r in df.collect())


def test_chain_names_and_rows(shop):
    df = merge_graph(shop, CHAIN)
    assert df.columns == ["customer", "order_no_order_id", "line_no", "part", "note_lines", "note_orders", "nation"]
    assert df.count() == 3


def test_widening_keeps_the_wider_key(shop):
    assert dict(merge_graph(shop, CHAIN).dtypes)["order_no_order_id"] == "bigint"


def test_link_order_and_direction_do_not_matter(shop):
    seen = set()
    for links in itertools.permutations(CHAIN):
        for flips in itertools.product([False, True], repeat=len(links)):
            turned = [Link(k.right, k.left, tuple((b, a) for a, b in k.pairs)) if f else k for k, f in zip(links, flips)]
            seen.add(tuple(values(merge_graph(shop, turned))))
    assert len(seen) == 1


def test_duplicate_and_reverse_links_make_one_composite_key(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "p int, q int, v string")
    b = spark.createDataFrame([(1, 1, "u"), (1, 3, "w")], "r int, s int, t string")
    for second in (Link.of("a", "b", ("q", "s")), Link.of("b", "a", ("s", "q"))):
        df = merge_graph({"a": a, "b": b}, [Link.of("a", "b", ("p", "r")), second])
        assert df.columns == ["p_r", "q_s", "v", "t"]
        assert [tuple(r) for r in df.collect()] == [(1, 1, "x", "u")]


def test_closing_a_cycle_adds_the_condition(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "x int, z int")
    b = spark.createDataFrame([(1, 5), (2, 5)], "x2 int, y int")
    c = spark.createDataFrame([(5, 1)], "y2 int, z2 int")
    links = [Link.of("a", "b", ("x", "x2")), Link.of("b", "c", ("y", "y2")), Link.of("c", "a", ("z2", "z"))]
    results = {tuple(values(merge_graph({"a": a, "b": b, "c": c}, order))) for order in itertools.permutations(links)}
    assert len(results) == 1
    assert merge_graph({"a": a, "b": b, "c": c}, links).count() == 1


def test_key_in_several_links_is_found_again(spark):
    n = spark.createDataFrame([(1, "n1"), (2, "n2")], "nk int, name string")
    c = spark.createDataFrame([(1, "c1"), (2, "c2")], "ck int, cn string")
    s = spark.createDataFrame([(1, "s1")], "sk int, sn string")
    links = [Link.of("c", "n", ("ck", "nk")), Link.of("n", "s", ("nk", "sk")), Link.of("c", "s", ("ck", "sk"))]
    df = merge_graph({"n": n, "c": c, "s": s}, links)
    assert df.columns == ["ck_nk_sk", "cn", "name", "sn"]
    assert merged_names({"n": n, "c": c, "s": s}, links)["s", "sk"] == "ck_nk_sk"
    assert df.count() == 1


def test_one_column_linked_to_two_columns(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, 1), (2, 3)], "p int, q int")
    df = merge_graph({"a": a, "b": b}, [Link.of("a", "b", ("k", "p"), ("k", "q"))])
    assert df.columns == ["k_p_q"] and [r[0] for r in df.collect()] == [1]


def test_link_within_a_table_is_a_filter(spark, shop):
    shop["pairs"] = spark.createDataFrame([("c1", 1, 1), ("c2", 1, 2)], "customer string, u int, v int")
    links = [*CHAIN, Link.of("pairs", "pairs", ("u", "v")), Link.of("pairs", "customers", ("customer", "customer"))]
    assert merge_graph(shop, links).count() == 2


def test_parts_merged_separately_then_together(spark):
    t = {n: spark.createDataFrame([(1, n)], f"k{n} int, v{n} string") for n in "abcd"}
    links = [Link.of("a", "b", ("ka", "kb")), Link.of("c", "d", ("kc", "kd")), Link.of("b", "c", ("kb", "kc"))]
    df = merge_graph(t, links)
    assert df.count() == 1 and df.columns[0] == "ka_kb_kc_kd"


def test_disconnected_tables_raise(spark, shop):
    with pytest.raises(DisconnectedTables, match="customers"):
        merge_graph(shop, CHAIN[:1])
    with pytest.raises(DisconnectedTables):
        merge_graph(shop, [*CHAIN, Link.of("orders", "nowhere", ("order_id", "x"))])


def test_unknown_column_raises(shop):
    with pytest.raises(UnsupportedColumn):
        merge_graph(shop, [Link.of("lines", "orders", ("nope", "order_id")), CHAIN[1]])


def test_row_ids_are_dropped_unless_linked(spark):
    a = spark.createDataFrame([(1, 5)], "id int, k int")
    b = spark.createDataFrame([(1, 5)], "id int, m int")
    assert merge_two(a, b, [("k", "m")]).columns == ["k_m"]
    assert merge_two(a, b, [("id", "id")]).columns == ["id", "k", "m"]


def test_null_keys_never_match_and_nan_equals_nan(spark):
    a = spark.createDataFrame([(None,), (float("nan"),), (1.0,)], "k double")
    assert merge_two(a, a, [("k", "k")]).count() == 2


def test_number_to_text_needs_the_option(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([("1",), ("x",)], "m string")
    with pytest.raises(KeyTypeMismatch):
        merge_two(a, b, [("k", "m")])
    assert merge_two(a, b, [("k", "m")], text_keys=True).collect() == [("1",)]


def test_empty_result_is_valid_unless_rows_are_required(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert merge_two(a, b, [("k", "k")]).count() == 0
    with pytest.raises(NoRows):
        merge_two(a, b, [("k", "k")], require_rows=True)


def test_replay_from_records(shop):
    records = [{"from": {"id": "lines"}, "to": {"id": "orders"}, "connections": [["order_no", "order_id"]]}, CHAIN[1].record()]
    assert values(replay(records, shop)) == values(merge_graph(shop, CHAIN))


def test_a_hot_key_is_split_by_adaptive_execution(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
        keys = spark.range(60000).select(F.col("id").alias("m"))
        df = merge_two(rows.repartition(8), keys, [("k", "m")])
        assert "skew=true" in run_plan_text(df)
        assert df.count() == 60000
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_whole_numbers_and_floats_match_exactly(spark):
    big = 9007199254740993  # no double has this value
    left = spark.createDataFrame([(big,), (big - 1,), (3,), (4,), (None,)], "a long")
    right = spark.createDataFrame([(float(big - 1),), (3.0,), (4.5,), (float("nan"),), (float("inf"),), (1e300,), (None,)], "b double")
    for one, other, pair in ((left, right, ("a", "b")), (right, left, ("b", "a"))):
        assert sorted(r[0] for r in merge_two(one, other, [pair]).collect()) == [3, big - 1]
