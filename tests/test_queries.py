"""Some registered queries of each area against DuckDB at the smallest scale; the driver compares them all."""

import glob
import os

import duckdb
import pytest

from granary import queries as library

SF = "/root/testdata/sf0.001"
SOME = "flagship logic_xor like_ci casts all_sub_null cte_rec_union join_natural_right join_theta group_firstrow rollup2 group_concat_distinct w_last_nth w_over_grouped distinct_order_other minus_folded fn_text_3 fn_date_parts fn_json dml_on_duplicate fk_set_null log_merge_latest log_budget sheet_overlay pack_round_trip fn_clock fn_rest log_source log_follow db_search_whole csv_round_trip tsv_source json_round_trip dump_round_trip windowed_counts create_index add_unique check_follows_rename".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = library.queries()[name](spark, SF)
    want = con.sql(library.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rows = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    assert got == rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", "view_scan_whole any_sub_whole join_using_whole fn_time_whole".split())
def test_whole_tables(spark, name):
    test_query(spark, name)
    text = library.oracle_sql()[name]
    assert not any(f"{key} <" in text for key in ("c_custkey", "p_partkey", "user_id", "event_id"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_guard_reads_whole_texts(spark):
    test_query(spark, "csv_guard_whole")
    longest = library.queries()["csv_guard_whole"](spark, SF).selectExpr("max(length(cell))").first()[0]
    assert longest >= spark.read.parquet(f"{SF}/documents.parquet").selectExpr("max(length(text))").first()[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["order_nulls_whole", "order_ordinal_alias_whole"])
def test_order_of_all_rows(spark, name):
    test_query(spark, name)
    assert library.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/customer.parquet").count()
