import pytest
from pyspark.sql import functions as F

from molfold.functions.columnar import with_molecule
from molfold.operators import grouping, ordering, screening, shuffling
from molfold.plans.chemistry import query_words
from molfold.sources import csvfile, fpfile, sdf, smi
from molfold.streaming.ingest import stream_hits, stream_smi


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_smi_rules(spark, tmp_path):
    p = write(tmp_path / "a.smi", "CCO\t ethanol \r\n\r\n# note\nC\tone\ttwo\nN\n\tempty\nO\rO\tlone\n")
    got = [tuple(r) for r in smi.read_smi(spark, p).collect()]
    assert got == [("CCO", "ethanol"), ("C", "one\ttwo"), ("N", ""), ("", "empty"), ("O\rO", "lone")]
    q = write(tmp_path / "b.smi", "smiles name\nCCO x y\nC\tz\n")
    assert [tuple(r) for r in smi.read_smi(spark, q, has_header=True, any_space=True).collect()] == [("CCO", "x y"), ("C", "z")]
    with pytest.raises(Exception):
        smi.read_smi(spark, str(tmp_path / "missing.smi")).collect()


def test_default_ids(spark, tmp_path):
    p = write(tmp_path / "a.smi", "CCO\nXX\nC\tme\nN\n")
    m = with_molecule(smi.read_smi(spark, p, with_position=True))
    assert [r.id for r in smi.fill_ids(m).orderBy("row").collect()] == ["MOL0", "me", "MOL2"]


def test_split_lines(spark):
    df = spark.createDataFrame([("a\r\n\nb\n",), ("",), ("x",), ("\n",)], "t string")
    assert [list(r[0]) for r in df.select(smi.split_lines("t")).collect()] == [["a", "", "b"], [], ["x"], [""]]


RECORD = """first
  program

  3  2  0  0  0  0  0  0  0  0999 V2000
    1.0000    2.0000   -0.5000 C   0  0
    0.0000    0.0000    0.0000 N   0  0
    0.0000    0.0000    0.0000 O   0  0
  1  2  2  0
  2  3  4  0
M  CHG  2   2   1   3  -1
M  END
> <MW>
12.5

> <NOTE>
one
two

> <MW>
99

$$$$
"""


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_sdf(spark, tmp_path, end):
    text = (RECORD + RECORD.replace("first", "").replace("  3  2", "  0  0", 1).replace("> <MW>", "> <Q>") + RECORD.replace("first", "third")).replace("\n", end)
    p = write(tmp_path / "a.sdf", text)
    got = sdf.read_sdf(spark, p, line_end=end).select("*", sdf.prop_double("MW").alias("mw"), sdf.prop_double("NOTE").alias("bad")).collect()
    names = [r.name for r in got]
    assert names[0] == "first" and names[-1] == "third"
    r = got[0]
    assert [(a.z, a.charge) for a in r.mol.atoms] == [(6, 0), (7, 1), (8, -1)]
    assert [(b.a, b.b, b.bond_order) for b in r.mol.bonds] == [(0, 1, 2), (1, 2, 5)]
    assert (list(r.x), list(r.y), list(r.z)) == ([1, 0, 0], [2, 0, 0], [-0.5, 0, 0])
    assert r.props == {"MW": "12.5", "NOTE": "one\ntwo"} and r.mw == 12.5 and r.bad is None


def test_sdf_stops_at_broken_counts(spark, tmp_path):
    p = write(tmp_path / "a.sdf", RECORD + RECORD.replace("  3  2", " xx  2") + RECORD)
    assert sdf.read_sdf(spark, p).count() == 1
    assert sdf.read_sdf(spark, p, stop_at_broken=False).count() == 2


def test_csv_line(spark):
    lines = ['a,b', 'a,"b,c",d', '"say ""hi""",x', '', 'a,,', 'x\r', 'a"b"c,"",""""', '"a""b"']
    want = [["a", "b"], ["a", "b,c", "d"], ['say "hi"', "x"], [""], ["a", "", ""], ["x"], ["abc", "", '"'], ['a"b']]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string")
    assert [list(r[0]) for r in df.orderBy("i").select(csvfile.parse_csv_line("t")).collect()] == want


def test_binary_shards(spark, tmp_path):
    rows = [(f"id{i}", [i, -i] + [0] * 30, i) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, fp array<bigint>, popcnt int")
    assert fpfile.write_shards(df, str(tmp_path / "f"), rows_per_shard=30) == 100
    back = fpfile.read_shards(spark, str(tmp_path / "f")).collect()
    assert sorted((r.id, list(r.fp), r.popcnt) for r in back) == sorted(rows)


def test_binary_checks():
    import numpy as np

    good = fpfile.encode(np.zeros((1, 32), np.int64), np.zeros(1, np.int32), ["a"])
    assert fpfile.decode(good, 32)[2] == ["a"]
    for data, words in ((good[:10], 32), (b"XXXX" + good[4:], 32), (good[:-1], 32), (good, 16), (good[:60], 32)):
        with pytest.raises(ValueError):
            fpfile.decode(data, words)


def test_ordering_with_hot_keys(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    got = [(r.k, r.id, r.position, r.run) for r in ordering.prefix_sum(ordering.dense_positions(df, ["k", "id"], ranges=40), ["k", "id"], F.col("id"), "run", ranges=9).orderBy("k", "id").collect()]
    total = 0
    for i, (k, ident, position, run) in enumerate(got):
        total += ident
        assert (position, run) == (i, total)
    empty = ordering.dense_positions(df.where("false"), ["k", "id"])
    assert empty.count() == 0
    med = ordering.upper_median(df, "k").first()[0]
    assert med == sorted(k for k, *_ in got)[1500]


def test_numbering_does_not_repeat_the_work_before_it(spark):
    """Positions are computed from rows stored with their range, and a shuffle from those."""
    df = spark.range(500).repartition(3).select((F.col("id") * 7 % 500).alias("k"))
    for numbered in (ordering.dense_positions(df, ["k"], ranges=5), shuffling.seeded_shuffle(df, ["k"], seed=3)):
        assert numbered.inputFiles() and all("/ranges-" in f for f in numbered.inputFiles())
    got = ordering.dense_positions(df, ["k"], ranges=5).collect()
    assert len(got) == 500 and all(r.k == r.position for r in got)
    assert [r.sorted for r in ordering.is_sorted(ordering.dense_positions(df, ["k"]), "position", "k").collect()] == [True]


def test_grouped_values_have_one_form_at_any_size(spark):
    """A key of 250,000 values is grouped like any other."""
    df = spark.range(300_000).select(F.when(F.col("id") < 250_000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    out = grouping.grouped_values(df.union(df.where("v < 5")), "k", "v")
    assert out.columns == ["k", "v", "n"]
    assert out.where("k = 0").count() == 250_000 and out.where("n = 2").count() == 5


def test_long_ids_are_refused(spark, tmp_path):
    import numpy as np

    with pytest.raises(ValueError, match="70000 bytes"):
        fpfile.encode(np.zeros((1, 32), np.int64), np.zeros(1, np.int32), ["x" * 70_000])


def test_binary_shards_by_uri(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    df = spark.createDataFrame([("a", [1] + [0] * 31, 1)], "id string, fp array<bigint>, popcnt int")
    path = f"file:{tmp_path}/by-uri"
    assert fpfile.write_shards(df, path) == 1
    assert fpfile.read_shards(spark, path).count() == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["by-uri"]


def test_sdf_refuses_what_the_format_cannot_count(spark):
    from molfold.functions.columnar import with_molecule

    df = with_molecule(spark.createDataFrame([("big", "C" * 1001)], "name string, smiles string"), "smiles")
    text = df.select(sdf.format_record("name", "mol", "array()", "array()", "array()", "map()"))
    with pytest.raises(Exception, match="999 atoms"):
        text.collect()


def test_staged_screen(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 300.0), (3, None), (4, 700.0)], "id int, mw double")
    s = screening.StagedScreen().add("low", F.col("mw") < 500).add("high", F.col("mw") > 200)
    assert [(r.name, r.remaining, r.removed) for r in s.report(df).orderBy("stage").collect()] == [("input", 4, 0), ("low", 2, 2), ("high", 1, 1)]
    assert [r.id for r in s.survivors(df).collect()] == [2]
    assert df.where(screening.any_of([])).count() == 0 and df.where(screening.all_of([])).count() == 4


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.smi", "CC(=O)Oc1ccccc1C(=O)O\taspirin\nCCO\tethanol\nXX\tbad\n")
    words = query_words(spark, "O=C(O)c1ccccc1OC(C)=O")
    hits = stream_hits(stream_smi(spark, str(tmp_path / "in")), words, 0.9)
    q = hits.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("hits").collect()] == [("aspirin", 1.0)]


def test_bad_query_is_an_error(spark):
    with pytest.raises(ValueError, match="unclosed"):
        query_words(spark, "CC(")


def test_write_smi_and_listing(spark, tmp_path):
    from molfold.sources.listing import list_files
    from molfold.sources.smi import read_smi, write_smi

    rows = [("CCO", "ethanol"), ("c1ccccc1", "ben zene"), ("C", "é")]
    folder = str(tmp_path / "out")
    write_smi(spark.createDataFrame(rows, "smiles string, id string"), folder)
    assert sorted((r.smiles, r.id) for r in read_smi(spark, folder).collect()) == sorted(rows)
    (tmp_path / "out" / "more.tar.gz").write_bytes(b"12345")
    (tmp_path / "out" / "plain").write_bytes(b"x")
    (tmp_path / "out" / "empty").write_bytes(b"")
    got = {r["name"]: (r.stem, r.extension, r.length) for r in list_files(spark, folder).collect()}
    assert got["more.tar.gz"] == ("more.tar", ".gz", 5) and got["plain"] == ("plain", "", 1) and "empty" not in got
    assert sum(length for name, (*_, length) in got.items() if name.endswith(".txt")) == sum(len(f"{s}\t{i}\n".encode()) for s, i in rows)
    assert [r["name"] for r in list_files(spark, folder, "*.gz").collect()] == ["more.tar.gz"]
