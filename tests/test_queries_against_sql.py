"""Queries against their SQL on small tables of odd rows: equal places, long orders, large keys."""

import duckdb
import pytest

import __spark_entry__ as entry

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"


def same(spark, tmp_path, name, tables):
    """Whether a query returns what its SQL returns of tables {name: (rows, schema)}."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["sections", "section_neighbours", "reader_sections", "display_titles"])
def test_line_items_of_one_place(spark, tmp_path, name):
    # of each order two items have one number and part: first-level headings, or the first heading of a section, which says its title
    rows = [(1, 1, 4, 1), (1, 2, 25, 1), (1, 2, 25, 2), (1, 3, 5, 1), (2, 1, 20, 1), (2, 2, 26, 1), (2, 2, 26, 2), (2, 3, 6, 1), (3, 1, 1, 1), (3, 1, 1, 2), (3, 2, 10, 3)]
    assert same(spark, tmp_path, name, {"lineitem": (rows, LINES)})


def test_contents_of_long_orders(spark, tmp_path):
    rows = [(o, 1 + n % 7, 100 * o + n, n) for o in range(60, 66) for n in range(19 + o % 3 * 10)]
    assert same(spark, tmp_path, "page_entries", {"lineitem": (rows, LINES)})


def test_colours_of_large_keys(spark, tmp_path):
    rows = [(k,) for k in (1, 215_000, 216_000, 1_200_000, 7_200_000, 9_000_000_000)]
    assert same(spark, tmp_path, "synthetic_artifact_spans", {"part": (rows, "p_partkey long")})
