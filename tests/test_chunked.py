"""Chunks of a stored table against all of it: every pair once, no row copied for the rows it meets."""

import uuid

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from molfold.functions import bits as B
from molfold.operators import chunked, leaders, scratch
from molfold.operators import search as K
from molfold.operators.leaders import sphere_exclusion

from . import brute


def near_words(seed, rows, width):
    """Fingerprints, some a few bits from others, of about a quarter of all bits."""
    rng = np.random.default_rng(seed)
    words = lambda n: rng.integers(0, 2**64, (n, width), dtype=np.uint64)
    fp = words(rows) & words(rows)
    near = fp[: rows // 2] ^ (words(rows // 2) & words(rows // 2) & words(rows // 2) & words(rows // 2) & words(rows // 2))
    out = np.unique(np.concatenate([fp, near]), axis=0)
    return rng.permutation(out[np.bitwise_count(out).sum(axis=1) > 0])


def rows_of(fp):
    at = np.arange(len(fp))
    return {"fp": fp, "popcnt": np.bitwise_count(fp).sum(axis=1, dtype=np.int64), "number": at * 7, "id": at, "copies": 1 + at % 3 * (at % 5 == 0), "unnamed": at < 0}


def part(rows, at):
    return {name: values[at] for name, values in rows.items()}


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
@pytest.mark.parametrize("width", [1, 3, 32])
@pytest.mark.parametrize("kind", [chunked.FoundPairs, chunked.FoundCounts])
def test_chunks_of_a_table_against_all_of_it(width, threshold, kind, monkeypatch):
    for name, value in (("TILE", 16), ("WAITING", 5), ("FULL", 3)):
        monkeypatch.setattr(chunked, name, value)
    fp = near_words(width, 120, width)
    rows = rows_of(fp)
    n, common = rows["popcnt"], np.bitwise_count(fp[:, None] & fp[None]).sum(axis=2, dtype=np.int64)
    score = common / (n[:, None] + n[None] - common)
    hit = score >= threshold
    got = []
    # popcounts in chunks, the rows in pieces of any size
    for chosen in np.array_split(np.argsort(n, kind="stable"), 4):
        chunk = chunked.Chunk(part(rows, chosen), threshold)
        found = kind(chunk)
        for piece in np.array_split(np.argsort(n, kind="stable"), 7):
            other = part(rows, piece)
            found.begin(other)
            chunk.compare(other, found)
            got += [r for batch in found.take() for r in batch.to_pylist()]
        got += [r for batch in found.rest() for r in batch.to_pylist()]
    if kind is chunked.FoundPairs:
        want = {(a, b): score[a, b] for a, b in zip(*np.nonzero(np.triu(hit, 1)), strict=True)}
        assert len(got) == len(want) and {(r["id_a"], r["id_b"]): r["score"] for r in got} == want
        assert all((r["copies_a"], r["copies_b"]) == (rows["copies"][r["id_a"]], rows["copies"][r["id_b"]]) for r in got)
    else:
        total = np.zeros(len(fp), np.int64)
        for r in got:
            total[r["number"] // 7] += r["n"]
        assert total.tolist() == ((hit & ~np.eye(len(fp), dtype=bool)) @ rows["copies"]).tolist()
    assert hit.sum() > len(fp) or threshold == 1.0


def test_folded_words_differ_in_no_more_bits():
    fp = near_words(9, 60, 32)
    apart = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    for size in (1, 2, 5, 31, 32):
        f = chunked.folded(fp, size).T
        folded = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2)
        assert (folded <= apart).all() and (size < 32 or (folded == apart).all())


def table(spark, fp, copies=1):
    rows = [(int(i), w) for k in range(copies) for i, w in enumerate(fp.view(np.int64).tolist(), k * len(fp))]
    return spark.createDataFrame(rows, "id long, fp array<long>").withColumn("popcnt", B.popcount("fp"))


@pytest.mark.parametrize("joined", [0, 100])
def test_all_pairs_by_chunks_and_by_rarest_bits(spark, monkeypatch, joined):
    monkeypatch.setattr(K, "JOINED_PAIR", joined)
    monkeypatch.setattr(K, "CHUNK_BLOCKS", 1)
    fp = near_words(4, 60, 3)
    sets = [{64 * k + j for k, w in enumerate(r.tolist()) for j in range(64) if w >> j & 1} for r in fp]
    pairs = K.all_pairs(table(spark, fp, 2), 0.6, 16)
    got = {(r.id_a, r.id_b): (r.score, r.copies_a, r.copies_b) for r in pairs.collect()}
    want = {(a, b): (brute.tanimoto(x, y), 2, 2) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and brute.tanimoto(x, y) >= 0.6}
    assert got == want and want
    # chunk by chunk nothing is dealt out again
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (joined == 0)


def test_rows_without_an_id_have_no_pairs(spark):
    """As in the SQL: they are neighbours, but there is no name for a pair."""
    words = [7, 15, 31, 63]
    df = spark.createDataFrame([(None if i == 2 else i, [w]) for i, w in enumerate(words)], "id long, fp array<long>").withColumn("popcnt", B.popcount("fp"))
    assert {(r.id_a, r.id_b) for r in K.all_pairs(df, 0.5).collect()} == {(0, 1), (0, 3), (1, 3)}
    assert {(r.id, r.neighbours) for r in K.neighbour_counts(df, 0.5).collect()} == {(0, 3), (1, 3), (3, 3), (None, 3)}


@pytest.mark.parametrize("together", [1, 3])
def test_rows_of_one_id_count_by_themselves(spark, monkeypatch, together):
    monkeypatch.setattr(chunked, "TOGETHER", together)
    monkeypatch.setattr(chunked, "CHUNK_BYTES", 1)
    words = [(0, 7), (1, 15), (1, 31), (3, 63), (3, 7 << 20)]
    df = spark.createDataFrame([(i, [w]) for i, w in words], "id long, fp array<long>").withColumn("popcnt", B.popcount("fp"))
    assert sorted(tuple(r) for r in K.neighbour_counts(df, 0.5).collect()) == [(0, 3), (1, 3), (1, 3), (3, 0), (3, 3)]


@pytest.mark.parametrize("step", ["counts", "spheres"])
def test_neighbours_are_not_stored_one_by_one(spark, tmp_path, step, monkeypatch):
    """Where most pairs are neighbours, what is written grows with the rows only."""
    monkeypatch.setattr(scratch, "scratch_path", lambda spark, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    fp = np.unique(near_words(5, 300, 1) | np.uint64(0xFFFFFFFFFFFF), axis=0)
    df = table(spark, fp)
    got = K.neighbour_counts(df, 0.4) if step == "counts" else sphere_exclusion(df, 0.4)
    assert got.agg(F.sum("neighbours")).first()[0] == len(fp) * (len(fp) - 1)
    rows = sum(pq.read_metadata(f).num_rows for f in tmp_path.rglob("*.parquet"))
    assert len(fp) <= rows < 12 * len(fp)


def test_leaders_of_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(leaders, "DECIDED", 5)
    fp = near_words(6, 40, 1)
    n = np.bitwise_count(fp).sum(axis=1)
    common = np.bitwise_count(fp & fp.T)
    near = common / (n[:, None] + n[None] - common) >= 0.5
    size, leader = near.sum(axis=1) - 1, {}
    for i in sorted(range(len(fp)), key=lambda i: (-size[i], i)):
        if i not in leader:
            for j in [i, *np.flatnonzero(near[i])]:
                leader.setdefault(int(j), i)
    got = {r.id: (r.leader, r.neighbours) for r in sphere_exclusion(table(spark, fp), 0.5).collect()}
    assert got == {i: (leader[i], size[i]) for i in range(len(fp))}
    assert len(set(leader.values())) > 10
