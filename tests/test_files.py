"""Vector files, packages and archives: round trips, broken input, and jobs that fail."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from sparklode.sources import archives, committed, packages, vectorfiles


def below(path):
    return sorted(os.path.join(d, f)[len(str(path)) + 1 :] for d, _, names in os.walk(path) for f in names)


def test_vector_files(spark, tmp_path):
    vectorfiles.register(spark)
    path = f"{tmp_path}/v"
    rows = [(k, [k + 0.5, -k * 1.0, 3.25]) for k in range(57)]
    frame = spark.createDataFrame(rows, vectorfiles.SCHEMA).repartition(3)
    frame.write.format("vectors").mode("overwrite").option("rows", 10).save(path)
    for n in (4, 1000):
        back = spark.read.format("vectors").option("rows", n).load(path)
        assert sorted((r["id"], r["embedding"]) for r in back.collect()) == rows
    assert spark.read.format("vectors").option("rows", 4).load(path).rdd.getNumPartitions() >= 15
    assert not [f for f in below(path) if "_staging" in f]
    with open(f"{path}/zz.meta.json", "w") as f:
        json.dump({"dim": 2, "ids": [1, 2]}, f)
    with open(f"{path}/zz.f32", "wb") as f:
        f.write(struct.pack("<3f", 1, 2, 3))
    with pytest.raises(Exception, match="doesn't hold 2 vectors of 2 floats"):
        spark.read.format("vectors").load(path).count()
    os.makedirs(f"{tmp_path}/none")
    assert spark.read.format("vectors").load(f"{tmp_path}/none").count() == 0


def test_failed_job_leaves_nothing(spark, tmp_path):
    """A task that fails after others have written: no file, no manifest, and an older package stays readable."""
    vectorfiles.register(spark)
    path = f"{tmp_path}/v"
    bad = spark.createDataFrame([(k, [1.0, None if k == 39 else 2.0]) for k in range(40)], vectorfiles.SCHEMA).repartitionByRange(4, "id")
    with pytest.raises(Exception, match="neither null ids nor null vectors"):
        bad.write.format("vectors").mode("overwrite").option("rows", 3).save(path)
    assert below(path) == []
    boom = F.udf(lambda k: 1 // (k - 1500) and k, "long")
    broken = spark.range(2000).select(F.col("id"), boom("id").alias("x"))
    place = f"{tmp_path}/p"
    packages.write_package(spark.range(700).select("id", (F.col("id") * 2).alias("x")), "id", place)
    before = below(place)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        packages.write_package(broken, "id", place)
    assert below(place) == before and packages.read_package(spark, place, "id long, x long").count() == 700


def test_package(spark, tmp_path):
    path = f"{tmp_path}/p"
    rows = spark.range(1203).select((F.lit(5000) - F.col("id")).alias("id"), F.when(F.col("id") % 3 == 0, F.lit("é\n\"x\"")).alias("s"), F.array(F.col("id")).alias("a"), F.lit("2024-01-02").cast("date").alias("d"))
    packages.write_package(rows, "id", path)
    files = committed.manifest(path)
    assert [f["rows"] for f in files] == [500, 500, 203] and [f["first"] for f in files] == [3798, 4298, 4798] and files[-1]["last"] == 5000
    lines = []
    for f in files:
        with open(f"{path}/{f['name']}.jsonl", "rb") as g:
            body = g.read()
        assert hashlib.sha256(body).hexdigest() == f["sha256"]
        lines += [json.loads(x) for x in body.decode().splitlines() if x]
    assert [x["id"] for x in lines] == list(range(3798, 5001)) and lines[0]["d"] == "2024-01-02" and {x["s"] for x in lines} == {None, 'é\n"x"'} and list(lines[0]) == ["id", "s", "a", "d"]
    assert packages.read_package(spark, path, "id long, s string").count() == 1203
    assert all(r["intact"] for r in packages.package_files(spark, path).collect())
    with open(f"{path}/{files[1]['name']}.jsonl", "ab") as g:
        g.write(b"more")
    assert [r["intact"] for r in packages.package_files(spark, path).orderBy("name").collect()] == [True, False, True]
    os.remove(f"{path}/manifest.json")
    assert packages.read_package(spark, path, "id long").count() == 0
    packages.write_package(rows.limit(0), "id", f"{tmp_path}/empty")
    assert committed.manifest(f"{tmp_path}/empty") == [] and below(f"{tmp_path}/empty") == ["manifest.json"]


def test_archives(spark, tmp_path):
    archives.register(spark)
    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dir/", "")
        z.writestr("dir/one.xml", "<all><row><a>1</a><b><c> x &amp; y </c></b></row><other/><row><a/></row></all>")
        z.writestr("cut.xml", "<all><row><a>2</a></row><row><a>3")
        z.writestr("page.html", "<p>é</p>")
        z.writestr("bytes.html", b"\xff\xfe\xff")
    with zipfile.ZipFile(f"{tmp_path}/b.zip", "w") as z:
        z.writestr("two.xml", "<all>" + "".join(f"<row><a>{k}</a></row>" for k in range(500)) + "</all>")
    read = spark.read.format("zip")
    found = read.option("element", "row").option("ending", ".xml").option("bytes", 10).load(str(tmp_path)).collect()
    one = sorted((r["position"], r["fields"], r["error"]) for r in found if r["member"] == "dir/one.xml")
    assert one == [(0, {"a": "1", "c": "x & y"}, None), (1, {"a": ""}, None)]
    assert [(r["position"], r["fields"], r["error"]) for r in found if r["member"] == "cut.xml"] == [(0, {"a": "2"}, None), (1, None, "ParseError")]
    assert [r["fields"]["a"] for r in found if r["archive"] == "b.zip"] == [str(k) for k in range(500)]
    whole = {r["member"]: (r["text"], r["error"]) for r in spark.read.format("zip").option("ending", ".html").load(f"{tmp_path}/a.zip").collect()}
    assert whole == {"page.html": ("<p>é</p>", None), "bytes.html": (None, "UnicodeDecodeError")}
    os.makedirs(f"{tmp_path}/none")
    assert spark.read.format("zip").load(f"{tmp_path}/none").count() == 0
