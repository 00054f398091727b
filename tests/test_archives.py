"""Archives of score logs: a task reads members, a filter on names is pushed down, a folder can be followed."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.sources import archives, ingest


def log(*scores, name="acc"):
    return {"samples": [{"id": f"s{k}", "scores": {name: {"value": x}}} for k, x in enumerate(scores)]}


def archive(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, value in members.items():
            z.writestr(f"{name}.json", value if isinstance(value, str) else json.dumps(value))
        z.writestr("notes.txt", "no member of ours")


@pytest.fixture
def folder(tmp_path):
    archive(tmp_path / "a.eval", header={"version": 2}, samples=log(0.5, 0.25))
    archive(tmp_path / "b.eval", early=log(0.1), late=log(0.2, 0.3, 0.4), summary={"version": 2})
    archive(tmp_path / "c.eval")
    archive(tmp_path / "d.eval", broken="{", samples=log(0.1))
    archive(tmp_path / "é f.eval", samples=log("C", "I", "ü"))
    (tmp_path / "plain.json").write_text(json.dumps(log(1.0)))
    (tmp_path / "_ignored.json").write_text("{")
    return tmp_path


def test_a_partition_a_member(spark, folder):
    rows = archives.read(spark, str(folder), partition_bytes=1)
    got = {(r["source"].rsplit("/", 1)[1], r["member"]): r["value"] for r in rows.collect()}
    assert len(got) == 10 and rows.rdd.getNumPartitions() == 9  # the archive without members has no bytes of its own
    assert got["c.eval", ""] == "{}" and json.loads(got["plain.json", None]) == log(1.0) and json.loads(got["b.eval", "early.json"]) == log(0.1)
    assert archives.read(spark, str(folder)).rdd.getNumPartitions() == 1
    assert archives.read(spark, f"{folder}/[ab].*").count() == 5
    with pytest.raises(Exception, match="file not found"):
        archives.read(spark, str(folder / "none")).count()


def test_filters_on_names_leave_members_unread(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        every = archives.read(spark, str(folder), partition_bytes=1, pushdown="true")
        some = every.where(F.col("member") == "samples.json")
        assert some.count() == some.rdd.getNumPartitions() == 3
        assert every.where(F.col("member").isin("early.json", "late.json") & (F.col("size") > 0)).count() == 2
        assert every.where("member = 'nothing.json'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_members_merge_in_name_order(spark, folder):
    rows = ingest.load(spark, "inspect", str(folder), 0.0, 1.0).withColumn("file", F.element_at(F.split("source", "/"), -1))
    got = sorted((r["file"], r["item_id"], r["issue"], r["normalised"]) for r in rows.where("file < 'c'").collect())
    assert got == [("a.eval", "s0", None, 0.5), ("a.eval", "s1", None, 0.25), ("b.eval", "s0", None, 0.2), ("b.eval", "s1", None, 0.3), ("b.eval", "s2", None, 0.4)]
    issues = {r["file"]: r["issue"] for r in rows.where("issue is not null").collect()}
    assert issues == {"c.eval": "no samples found", "d.eval": "a member is not JSON", "é f.eval": "no numeric score"}


def test_a_folder_followed_over_restarts(spark, folder, tmp_path_factory):
    """Files that come later are read once, after a restart from the checkpoint, too."""
    mark, out = str(tmp_path_factory.mktemp("mark")), str(tmp_path_factory.mktemp("out"))

    def run():
        archives.follow(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", mark).start(out).processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return spark.read.schema(archives.SCHEMA).parquet(out).count()

    assert run() == 10
    archive(folder / "0 later.eval", samples=log(0.9), more={"version": 2})
    assert run() == 12
    assert run() == 12
