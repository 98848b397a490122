import pytest

from fathomry.operators import graph
from fathomry.plans.views import Views


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_module_rows_keep_every_pair(spark, sf):
    v = Views(spark, f"/root/testdata/{sf}")
    nation, item, orders, supplier, customer = (v.table(t).toPandas() for t in ("nation", "lineitem", "orders", "supplier", "customer"))
    all_rows = item.merge(orders, left_on="l_orderkey", right_on="o_orderkey").merge(supplier, left_on="l_suppkey", right_on="s_suppkey").merge(customer, left_on="o_custkey", right_on="c_custkey")
    name = dict(zip(nation.n_nationkey, nation.n_name, strict=True))
    want = {}
    for s, c, flag in zip(all_rows.s_nationkey, all_rows.c_nationkey, all_rows.l_returnflag, strict=True):
        want[name[s], name[c]] = want.get((name[s], name[c]), True) and flag != "N"
    got = v.module_rows.collect()
    assert len(got) == len(want) and {(r.src, r.dst): r.is_dynamic for r in got} == want
    edges = {(r.src, r.dst) for r in graph.typed_edges(v.module_rows).collect()}
    assert edges == {p for p in want if p[0] != p[1]} and edges
