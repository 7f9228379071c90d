"""Plans as they should be: pruned scans, pushed filters, no Python where none is needed."""

import re

import pytest
from helpers import DATA

from statsift import cases, route_queries  # noqa: F401  (register their queries)
from statsift.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


#: Queries that need Python for bytes; all others stay in the JVM.
PYTHON = {"q33_compressed", "q34_zip_members", "q35_character_sets", "c_sidecars"}


#: The routes' queries are cut into written tables, so their plans show the last step alone.
LAZY = {n for n in QUERIES if not n.startswith("r_")}


@pytest.mark.parametrize("name", sorted(LAZY - PYTHON))
def test_no_python(spark, name):
    assert not re.search("Python|Pandas|MapInArrow", plan(QUERIES[name](spark, DATA)))


@pytest.mark.parametrize(("name", "columns"), [("q02_url_parts", "page_id:bigint,url:string"), ("q08_cross_checks", None), ("q17_transfer", "lang:string,n_chars:bigint"), ("q26_md5", "doc_id:bigint,text:string"), ("q19_stratified", "l_quantity:double,l_returnflag:string,l_linestatus:string")])
def test_columns_are_pruned(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, DATA)))
    assert read and all(len(r.split(",")) < 8 for r in read)
    if columns:
        assert columns in read


def test_filters_are_pushed(spark):
    assert "LessThan(c_nationkey,8)" in plan(QUERIES["q14_merge_hits"](spark, DATA))


def test_top_k_does_not_sort_all(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["q12_search_top"](spark, DATA))


@pytest.mark.parametrize("name", sorted(LAZY))
def test_no_cross_product(spark, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, DATA))
