"""Versions of the published tables."""

from stopgrid.plans import publish as P


def test_versions_and_order(spark, tmp_path):
    root = f"file://{tmp_path}/live"
    assert P.live_version(spark, root) is None
    rows = [(f"m{i % 3}", f"{(i * 7919) % 40000:05d}") for i in range(40000)]
    names = spark.createDataFrame(rows, "mode string, folded string").repartition(1)
    first = P.publish({"station_names": names, "t": spark.range(3)}, root)
    old = P.live_tables(spark, root)
    second = P.publish({"station_names": names.limit(5), "t": spark.range(4)}, root)
    assert P.live_version(spark, root) == second != first
    assert old("t").count() == 3 and P.read_live(spark, root, "t").count() == 4
    for m in ("m0", "m1", "m2"):
        folded = [r["folded"] for r in old("station_names").where(f"mode = '{m}'").collect()]
        assert folded == sorted(folded) and len(folded) > 13000
    P.publish({"t": spark.range(5)}, root)
    assert not (tmp_path / "live" / first).exists() and (tmp_path / "live" / second).exists()
    assert P.read_live(spark, root, "t").count() == 5
