from __future__ import annotations

import json
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillon import cli
from quillon.sources import generators, reports
from quillon.sources.binary import infer_n_rows, read_rows, write_rows


def test_round_trip(spark, tmp_path):
    path = tmp_path / "rows.bin"
    ids = [0, 1, 2**63 - 1]
    path.write_bytes(b"".join(struct.pack("<Qd", i, i / 2) for i in ids))
    assert infer_n_rows(str(path)) == 3
    df = read_rows(spark, str(path), 3, range_bytes=16)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r[0] for r in df.collect()) == ids
    write_rows(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_rows(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))
    write_rows(df.limit(1), str(tmp_path / "out"))
    assert infer_n_rows(str(tmp_path / "out")) == 1


def test_unsigned_ids(spark, tmp_path):
    path = tmp_path / "rows.bin"
    path.write_bytes(b"".join(struct.pack("<Qd", i, 1.0) for i in (2**63, 2**64 - 2)))
    assert sorted(r[0] for r in read_rows(spark, str(path), ids="decimal").collect()) == [Decimal(2**63), Decimal(2**64 - 2)]
    with pytest.raises(Exception, match="decimal"):
        read_rows(spark, str(path)).collect()


def test_bad_files(spark, tmp_path):
    path = tmp_path / "rows.bin"
    path.write_bytes(b"x" * 20)
    with pytest.raises(ValueError):
        infer_n_rows(str(path))
    path.write_bytes(b"x" * 32)
    with pytest.raises(ValueError):
        read_rows(spark, str(path), 1)
    path.write_bytes(b"")
    assert read_rows(spark, str(path)).count() == 0


@pytest.mark.parametrize("distribution", generators.DISTRIBUTIONS)
@pytest.mark.parametrize("alpha", [0.5, 1.3])
def test_distributions(spark, distribution, alpha):
    ids = generators.group_ids(spark, 5000, 100, distribution, alpha)
    low, high, n = ids.agg(F.min("group_id"), F.max("group_id"), F.count("*")).first()
    assert 0 <= low and high < 100 and n == 5000
    assert ids.orderBy("id").collect() == generators.group_ids(spark, 5000, 100, distribution, alpha).orderBy("id").collect()


def test_shares(spark):
    hot = generators.group_ids(spark, 20000, 100, "heavy_hitter").where("group_id < 10").count() / 20000
    assert 0.47 < hot < 0.53
    hot = generators.group_ids(spark, 20000, 100, "self_similar").where("group_id < 20").count() / 20000
    assert 0.77 < hot < 0.83


def test_values(spark):
    rows = spark.range(20000)
    means = rows.select(*[generators.values(d, 50.0).alias(d) for d in ("exponential", "uniform", "constant")]).agg({d: "avg" for d in ("exponential", "uniform", "constant")}).first()
    assert all(abs(m - 50) < 2 for m in means)
    with pytest.raises(ValueError):
        generators.values("normal")


def test_rare_groups_and_manifest(spark, tmp_path):
    recipe = generators.DATASETS["tiny"]
    rare = generators.generate(spark, recipe, shuffle=True).where("group_id >= 50")
    assert rare.select("group_id").distinct().count() == 5 and rare.select("value").distinct().first()[0] == 10000.0
    entries = generators.write_datasets(spark, [recipe], str(tmp_path))
    assert json.loads((tmp_path / "manifest.json").read_text()) == entries
    assert entries[0]["n_rows"] == infer_n_rows(entries[0]["path"])


def test_command_line_and_reports(spark, tmp_path):
    generators.write_datasets(spark, [generators.DATASETS["S0"]], str(tmp_path))
    data = str(tmp_path / "S0")
    common = ["--input", data, "--k", "5", "--fa-capacity", "100", "--n-partitions", "500", "--measure-m", "4", "--min-rows-per-core", "0"]
    assert cli.main([*common, "--output", str(tmp_path / "all.json"), "--all-modes"], spark) == 0
    report = json.loads((tmp_path / "all.json").read_text())
    assert all(m["matches_exact_top_k_results"] for m in report["comparisons"]["per_mode"].values())
    (tmp_path / "runs").mkdir()
    for mode in ("brute-force", "ext-b"):
        assert cli.main([*common, "--mode", mode, "--output", str(tmp_path / f"runs/S0_{mode}.json"), "--output-fa-groups"], spark) == 0
    found = reports.read_results(spark, str(tmp_path / "runs/*.json"))
    assert {(r["dataset"], r["mode"]) for r in found.collect()} == {("S0", "brute-force"), ("S0", "ext-b")}
    text = reports.markdown_report(found)
    assert text.index("brute-force") < text.index("ext-b") and "Pass 2+ (ms)" in text
    rows = [r.asDict() for r in found.select("dataset", "mode", "total_duration_ms").collect()]
    reports.append_csv(rows, str(tmp_path / "runs.csv"))
    reports.append_csv(rows, str(tmp_path / "runs.csv"))
    assert spark.read.csv(str(tmp_path / "runs.csv"), header=True).count() == 4
    with pytest.raises(SystemExit):
        cli.main([*common, "--output", "x", "--unknown"], spark)


def test_parquet_input(spark, tmp_path):
    assert cli.main(["--input", "/root/testdata/sf0.001/lineitem.parquet", "--group-cols", "l_suppkey", "--value-col", "l_quantity", "--k", "3", "--mode", "ext-ab", "--output", str(tmp_path / "x.json")], spark) == 0
    assert len(json.loads((tmp_path / "x.json").read_text())["top_k_results"]) == 3


def test_sweep(spark, tmp_path, capsys):
    path = str(tmp_path / "runs.csv")
    from quillon import sweep

    assert sweep.main(["--csv", path, "--sizes", "3000", "4000", "--modes", "baseline", "ext-b", "--fa-capacity", "300", "--n-partitions", "64", "--figures", str(tmp_path / "figures")], spark) == 0
    assert len(list((tmp_path / "figures").glob("*.svg"))) == 9
    runs = reports.read_csv(spark, path)
    n = len(generators.DISTRIBUTIONS) + 4 + 6 + 2
    assert runs.count() == 3 * n and runs.where("correct AND error IS NULL OR correct AND error = ''").count() == 3 * n
    assert {r[0] for r in runs.select("k").distinct().collect()} == set(sweep.K_VALUES)
    table = reports.results_table(runs)
    assert table.count() >= 2 * n and table.where("speedup IS NULL OR exact_Mrows_s IS NULL").isEmpty()
    assert "Speed-up" in capsys.readouterr().out


def test_suite_names():
    names = [r.name for r in generators.suite((1_000_000, 5_000))]
    assert "zipf_1M_G100K" in names and "uniform_5K_G500" in names and len(names) == 12


def test_figures(spark, tmp_path):
    import xml.etree.ElementTree as ET

    from quillon.sources import charts

    modes = ["brute-force", "baseline", "ext-a", "ext-b", "ext-ab"]
    rows = [(d, m, n, 10.0 * (i + 1) * n, i) for d, n in (("D1", 100), ("D2 <&>", 200), ("scale_1", 100), ("scale_2", 300)) for i, m in enumerate(modes)]
    runs = spark.createDataFrame(rows, "dataset string, mode string, n_rows long, total_duration_ms double, total_passes int")
    figures = charts.run_figures(runs)
    assert [f.name for f in figures] == ["execution_time", "passes", "scaling"]
    assert figures[0].places == ("D1", "D2 <&>") and list(figures[0].series) == modes and list(figures[1].series) == modes[1:]
    assert figures[2].series["baseline"] == (2000.0, 6000.0)
    for path, fig in zip(charts.write_figures(spark, figures, str(tmp_path)), figures):
        tree = ET.parse(path).getroot()
        name = lambda x: x.tag.rsplit("}", 1)[1]
        marks = [x for x in tree.iter() if name(x) in ("path", "circle") and any(name(c) == "title" for c in x)]
        assert len(marks) == sum(v is not None for s in fig.series.values() for v in s)
        colours = [x.get("fill") for x in tree if name(x) == "rect" and x.get("rx")]
        assert len(colours) == len(set(colours)) == len(fig.series)
        for x in tree.iter():
            if name(x) == "circle":
                assert charts.LEFT <= float(x.get("cx")) <= charts.WIDTH - charts.RIGHT and charts.TOP <= float(x.get("cy")) <= charts.HEIGHT - charts.BOTTOM
    few = runs.where("mode = 'baseline' AND dataset = 'D1'")
    assert [f.name for f in charts.run_figures(few)] == ["execution_time", "passes"] and charts.run_figures(few.where("false")) == []
    assert charts.steps(0) == [0.0, 1.0] and charts.steps(0.0123)[-1] >= 0.0123 and charts.steps(97)[-1] == 100
    two = charts.Figure("x", "x", "times", (1, 2), {"first pass": (1.0, None), "whole run": (2.0, 3.0)}, True)
    assert len(set(charts.colours(two).values())) == 2
