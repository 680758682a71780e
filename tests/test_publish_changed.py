"""Publishing only what changed, counted merges, quarantine and the gate on table files."""

from __future__ import annotations

import json

import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.__main__ import main
from roadworthy.plans.pipeline import publish_changed_all, run_statistics
from roadworthy.session import path_exists, shared_dir, temporary_dir
from roadworthy.sources import ingest as I
from roadworthy.sources import publish, tables
from roadworthy.sources.bindings import bind


def _files(spark, base):
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/*/*/*.json")
    fs = jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(f.getPath()).split(base)[1]: f.getModificationTime() for f in fs.globStatus(jp)}


def _doc(spark, rows):
    return spark.createDataFrame(rows, "merk string, n bigint, per_year map<string,double>")


ROWS = [("audi", 1, {"3": 0.5}), ("BMW", 2, None), ("bmw m", 3, {}), ("VW", 4, {"1": 1.0, "2": None}), (None, 5, None), ("", 6, None), ("ÖÖ", 7, None)]


def _published(spark, base, df):
    return sorted((tuple(r) for r in publish.read_published(spark, f"{base}/doc", df.schema).collect()), key=repr)


def test_only_changed_prefixes_are_rewritten(spark):
    with temporary_dir(spark, "out") as base, temporary_dir(spark, "work") as work:
        df = _doc(spark, ROWS)
        assert publish.publish_changed(df, "doc", base, f"{work}/0", "merk") == ["A", "B", "V", "other"]
        assert _published(spark, base, df) == sorted(map(tuple, df.collect()), key=repr)
        before = _files(spark, base)
        # Other order, other partitions, same content.
        assert publish.publish_changed(df.orderBy(F.desc("n")).repartition(5), "doc", base, f"{work}/1", "merk") == []
        assert _files(spark, base) == before
        changed = [r if r[0] != "bmw m" else ("bmw m", 3, {"9": 0.0}) for r in ROWS if r[0] != "VW"]
        assert publish.publish_changed(_doc(spark, changed), "doc", base, f"{work}/2", "merk") == ["B", "V"]
        after = _files(spark, base)
        kept = {f: t for f, t in before.items() if "prefix=A" in f or "prefix=other" in f}
        assert kept.items() <= after.items() and not any("prefix=V" in f for f in after) and len(kept) == len(after) - 1
        assert _published(spark, base, df) == sorted(map(tuple, _doc(spark, changed).collect()), key=repr)
        assert publish.publish_changed(df.where("false"), "doc", base, f"{work}/3", "merk") == ["A", "B", "other"]
        assert _files(spark, base) == {}


def test_a_run_that_ended_early_is_made_good(spark):
    with temporary_dir(spark, "out") as base, temporary_dir(spark, "work") as work:
        df = _doc(spark, ROWS)
        publish.publish_changed(df, "doc", base, f"{work}/0", "merk")
        # As if the run had stopped between the first write and the tree: other rows lie there, the tree does not.
        _doc(spark, [("audi", 99, None), ("zz", 1, None)]).withColumn("prefix", publish.document_prefix("merk")).write.mode("append").partitionBy(
            "prefix").json(f"{base}/doc")
        from roadworthy.session import remove_path

        remove_path(spark, f"{base}/{publish.TREE}/doc")
        assert publish.publish_changed(df, "doc", base, f"{work}/1", "merk") == ["A", "B", "V", "Z", "other"]
        assert _published(spark, base, df) == sorted(map(tuple, df.collect()), key=repr)


def test_an_unchanged_run_writes_no_document(spark):
    src = bind(spark, SF0001)
    with temporary_dir(spark, "out") as base:
        done = []
        for _ in range(2):
            with temporary_dir(spark, "work") as work:
                out = run_statistics(spark, src, P.TEST_SF0001, base_dir=work)
                done.append((publish_changed_all(spark, out, base, work), _files(spark, base)))
        assert all(done[0][0].values()) and len(done[0][0]) == 8
        assert not any(done[1][0].values()) and done[1][1] == done[0][1]


def test_merge_is_counted_while_it_is_written(spark):
    v = bind(spark, SF0001).vehicles.select(*[f.name for f in tables.SCHEMAS["voertuigen"].fields])
    merged, report = I.merge_observed(v, shared_dir(spark, "merge"), tables.SCHEMAS["voertuigen"], drop_columns={"1": [P.CATALOGUSPRIJS]})
    row = report.first()
    assert row.ok and row.source_rows == row.shard_rows == row.merged_rows == v.count() == sum(row.group_rows) and len(row.group_rows) == 2
    assert merged.count() == row.merged_rows
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # no table is read to be counted
    empty, report = I.merge_observed(v.where("false"), shared_dir(spark, "merge"), tables.SCHEMAS["voertuigen"])
    assert empty.collect() == [] and report.first().ok


def test_shard_files_follow_the_size_of_the_data(spark):
    v = bind(spark, SF0001).vehicles.repartition(16)
    base = shared_dir(spark, "shards")
    I.write_shards(v, base)
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/shard=*/*.csv")
    fs = jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert len(list(fs.globStatus(jp))) <= 18  # about one a prefix, not one a prefix and task (144)


def test_lines_that_do_not_fit_are_kept_apart(spark):
    base = shared_dir(spark, "lines")
    lines = ["a,b,c", "1,2,3", "1,2", "", "1,2,3,4", '"x,y",,z', '7,"open', " 8 ,9,\t"]
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(f"{base}/in")
    good, bad = I.stage_csv(spark, f"{base}/in", f"{base}/staged")
    assert good.columns == ["a", "b", "c"]
    assert sorted(map(tuple, good.collect()), key=repr) == sorted([("1", "2", "3"), ("x,y", None, "z"), (" 8 ", "9", "\t")], key=repr)
    got = bad.collect()
    assert sorted(r.line for r in got) == sorted(["1,2", "1,2,3,4", '7,"open']) and all(r.file.endswith(".txt") for r in got)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_is_bad" in plan
    with pytest.raises(ValueError):
        I.stage_csv(spark, f"{base}/in", f"{base}/staged2", header=False)


def _tables(spark, base):
    src = bind(spark, SF0001)
    for name, df in {"voertuigen": src.vehicles, "meldingen": src.inspections, "geconstateerde_gebreken": src.defects,
                     "gebreken": src.codes, "brandstof": src.fuel}.items():
        df.write.parquet(f"{base}/{name}.parquet")


def test_a_run_stops_on_a_small_or_missing_file(spark, capsys):
    with temporary_dir(spark, "tables") as base, temporary_dir(spark, "out") as out:
        _tables(spark, base)
        with pytest.raises(ValueError, match="voertuigen: too small"):
            main(["--tables", base, "--out", out, "--check-files"])
        with pytest.raises(ValueError, match="rijbewijs: missing"):
            I.assert_files(I.table_file_checks(spark, base, ["rijbewijs"]))
        I.assert_files(I.table_file_checks(spark, base, list(tables.DATASETS.values()), {n: 100 for n in tables.DATASETS.values()}))
        assert not path_exists(spark, f"{out}/brand_stats")
        for expected in (True, False):
            main(["--tables", base, "--out", out, "--only-changed"])
            first = json.loads(capsys.readouterr().out.split('}\n{')[0].split("\n}\n")[0] + "\n}")["rewritten"]
            assert bool(first["metadata"]) == expected
