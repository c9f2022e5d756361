"""Bad JSON lines are kept apart with their reason; exports come in files of a given size."""

import glob
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlens.sources.quarantine import NOT_JSON, WRONG_TYPE, read_quarantined
from cohortlens.sources.sized import ManifestMismatch, export_sized, read_manifest, read_sized
from conftest import rows


def _write(top, name, lines):
    with open(f"{top}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


def test_every_line_is_a_good_row_or_in_quarantine(spark):
    top = tempfile.mkdtemp(prefix="cohortlens-bad-")
    good = [{"user_id": f"u{i}", "elite": e, "extra": {"x": i}} for i, e in enumerate(["2010, 2012", "None", None, "", 'a "quoted" é'])]
    bad = [('{"user_id": "u9", "eli', NOT_JSON), ("[1, 2]", NOT_JSON), ('[{"user_id": "u8"}]', NOT_JSON), ("5", NOT_JSON), ("plain text", NOT_JSON), ('{"elite": "2010"}', "no user_id"), ('{"user_id": null}', "no user_id")]
    _write(top, "a.json", [json.dumps(g, ensure_ascii=False) for g in good] + ["", "  "] + [b for b, _ in bad[:3]])
    _write(top, "b.json", [b for b, _ in bad[3:]])
    found = read_quarantined(spark, "user", top)
    read = {x.user_id: (x.elite, x.yelping_since) for x in found.good.collect()}
    assert found.good.count() == len(good) and read == {g["user_id"]: (g["elite"], None) for g in good}
    got = {(os.path.basename(x.file), x.line, x.reason) for x in found.quarantine.collect()}
    assert got == {("a.json" if i < 3 else "b.json", *b) for i, b in enumerate(bad)}


def test_values_of_another_type_and_no_lines(spark):
    top = tempfile.mkdtemp(prefix="cohortlens-bad-")
    lines = ['{"alias": "a", "title": "A", "parents": []}', '{"alias": "b", "title": "B", "parents": {"x": 1}}', '{"title": "C"}']
    _write(top, "t.json", lines)
    found = read_quarantined(spark, "taxonomy", top)
    assert [(x.alias, x.parents) for x in found.good.collect()] == [("a", [])]
    assert rows(found.quarantine, "line", "reason") == sorted([(lines[1], WRONG_TYPE), (lines[2], "no alias")])
    _write(top, "t.json", [])
    found = read_quarantined(spark, "taxonomy", top)
    assert found.good.count() == found.quarantine.count() == 0


def test_files_are_of_the_size_on_skewed_input(spark):
    # Nearly all rows in one partition, and lines from a few bytes to 2 KB.
    text = F.repeat(F.lit("x\ty\n\"z"), F.when(F.col("id") % 10 == 0, 300).otherwise(F.col("id") % 5).cast("int"))
    df = spark.range(30_000).select("id", text.alias("t"), F.when(F.col("id") % 3 == 0, "k").alias("k")).repartition(8, F.lit(1))
    path, target = f"{tempfile.mkdtemp(prefix='cohortlens-sized-')}/out", 400_000
    manifest = export_sized(df, path, target).collect()
    sizes = [os.path.getsize(p) for p in glob.glob(f"{path}/part-*")]
    assert len(sizes) > 5 and all(0.7 * target <= s <= 1.3 * target for s in sizes)
    assert sorted(x.bytes for x in manifest) == sorted(sizes) and sum(x.rows for x in manifest) == 30_000
    key = F.xxhash64("id", F.coalesce("t", F.lit("")), F.coalesce("k", F.lit("-")))
    same = [read_sized(spark, path, df.schema), df]
    assert len({x.select(F.bit_xor(key), F.count("*")).first() for x in same}) == 1


def test_manifest_notices_lost_and_extra_files(spark):
    path = f"{tempfile.mkdtemp(prefix='cohortlens-sized-')}/out"
    df = spark.range(1000).select(F.col("id").cast("string").alias("a"))
    export_sized(df, path, 1000)
    assert rows(read_sized(spark, path, df.schema)) == rows(df)
    with open(f"{path}/part-99999.csv", "w") as f:
        f.write("a\n1\n")
    with pytest.raises(ManifestMismatch, match="part-99999"):
        read_sized(spark, path, df.schema)
    export_sized(df.where("false"), path, 1000)
    assert read_sized(spark, path, df.schema).count() == 0 and rows(read_manifest(spark, path), "rows") == [(0,)]
