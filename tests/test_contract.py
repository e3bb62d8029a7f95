"""The registry: names, SQL coverage, schemas and the flagship query."""

import __spark_entry__ as entry
from meterloom.plans import load_catalog

SMALL = "/root/testdata/sf0.001"


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 200
    ids = {n.split("_")[0] for n in q}
    want = {f"{p}{i:02d}" for p, n in (("s", 20), ("l", 7), ("p", 13), ("j", 24), ("a", 60), ("g", 12), ("w", 29), ("o", 8), ("u", 3), ("m", 41), ("v", 5), ("f", 5), ("r", 7)) for i in range(1, n + 1)}
    assert want - ids == set()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == [n for n, _ in load_catalog()[entry.FLAGSHIP].out] and df.count() > 0


def test_types(spark):
    kinds = {"i": "bigint", "s": "string", "b": "boolean", "d": "double"}
    for name in ("p05_hour_weekday", "a12_bucket_resample", "l01_canonical_labels", "s14_layer_profile"):
        df = entry.queries()[name](spark, SMALL)
        assert dict(df.dtypes) == {n: kinds[k[0]] for n, k in load_catalog()[name].out}
