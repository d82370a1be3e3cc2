"""Python data sources against the readers built on Spark's own sources."""

import io
import random

import pytest
from pyspark.sql import functions as F

from molfold.sources import fpfile, sdf
from molfold.sources import formats as R

BLOCK = """{name}
  program

  3  2  0  0  0  0  0  0  0  0999 V2000
    1.0000    2.0000   -0.5000 C   0  0
    0.0000    0.0000    0.0000 N   0  0
    0.0000    0.0000    0.0000 Xx  0  0
  1  2  2  0
  2  3  4  0
M  CHG  2   2   1   3  -1
M  END
> <MW>
12.5

> <NOTE>
two
lines

> <MW>
again

$$$$
"""


def texts():
    rng = random.Random(6)
    out = [BLOCK.format(name=f"mol {k}" + "x" * rng.randrange(60)) for k in range(40)]
    out.insert(3, "broken\n\n\nnot counts\nM  END\n$$$$\n")
    out.insert(7, "$$$$ empty\n")
    out.insert(9, "none\n\n\n  0  0  0\nM  END\n$$$$\n")
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("last", [True, False])
def test_every_record_once_whatever_the_ranges(end, last):
    data = "".join(texts())
    data = (data if last else data[: data.rindex("$$$$")]).replace("\n", end).encode()
    whole = list(R.sdf_texts(io.BytesIO(data), 0, len(data)))
    assert len(whole) == 42
    for split in (1, 7, 100, 333, 5000):
        parts = [r for low in range(0, len(data), split) for r in R.sdf_texts(io.BytesIO(data), low, min(low + split, len(data)))]
        assert parts == whole, split


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_sdf_format(spark, tmp_path, end):
    R.register_formats(spark)
    path = tmp_path / "a.sdf"
    path.write_bytes("".join(texts()).replace("\n", end).encode())
    rows = lambda df: sorted((r.asDict(True) for r in df.collect()), key=lambda r: r["name"])
    got = spark.read.format("sdf").option("splitBytes", 500).load(str(path))
    want = sdf.read_sdf(spark, str(path), stop_at_broken=False, line_end=end)
    assert rows(got) == rows(want) and got.count() == 40
    few = spark.read.format("sdf").schema("props map<string,string>, name string").load(str(tmp_path))
    assert few.columns == ["props", "name"] and few.first().props == {"MW": "12.5", "NOTE": "two\nlines"}


def test_filters_are_made_before_parsing(spark, tmp_path):
    (tmp_path / "a.sdf").write_text("".join(texts()))
    R.register_formats(spark)
    df = spark.read.format("sdf").load(str(tmp_path)).where(F.col("name").startswith("mol 1")).select("name")
    assert df.count() == 11
    fps = spark.createDataFrame([(str(k), [k, -k], k % 50) for k in range(1000)], "id string, fp array<bigint>, popcnt int").repartition(3)
    fpfile.write_shards(fps, str(tmp_path / "fp"), words=2, rows_per_shard=150)
    read = spark.read.format("fpdb").option("splitRows", 64).load(str(tmp_path / "fp"))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, fps.collect()))
    banded = read.where("popcnt >= 10 AND popcnt < 12")
    assert sorted(map(tuple, banded.collect())) == sorted(map(tuple, fps.where("popcnt IN (10, 11)").collect()))
    assert sorted(r.popcnt for r in read.where("popcnt = 7").select("popcnt").collect()) == [7] * 20


def test_pushed_bounds():
    reader = R.FingerprintReader(None, {})
    left = list(reader.pushFilters([R.GreaterThan(("popcnt",), 3), R.LessThanOrEqual(("popcnt",), 9), R.EqualTo(("id",), "x")]))
    assert (reader.low, reader.high) == (4, 9) and [f.attribute for f in left] == [("id",)]


def test_missing_and_foreign_files(spark, tmp_path):
    R.register_formats(spark)
    with pytest.raises(Exception, match="none.sdf"):
        spark.read.format("sdf").load(str(tmp_path / "none.sdf")).collect()
    (tmp_path / "bad.fpdb").write_bytes(b"x" * 40)
    with pytest.raises(Exception, match="bad magic"):
        spark.read.format("fpdb").load(str(tmp_path)).collect()
