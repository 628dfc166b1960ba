"""Hashes of files of any size and number."""

import hashlib
import os
import resource

from tessera.sources import tables as T
from tessera.streaming import file_events as W


def test_paths_are_resolved_one_by_one(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("x a.txt", "two"), ("p%20q.txt", "three")):
        (tmp_path / name).write_text(text)
    paths = [f"{tmp_path}/a.txt", f"{tmp_path}/x a.txt", f"file:{tmp_path}/p%20q.txt", f"{tmp_path}/gone.txt", "a.txt", None]
    rows = W.resolved(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [r["hash"] for r in rows] == [sha("one"), sha("two"), sha("three"), None, None, None]


def test_many_paths_in_one_batch(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    paths = spark.range(12_000).selectExpr(f"'{tmp_path}/f' as path", "id")
    assert W.resolved(paths).where("hash is not null").count() == 12_000


def test_a_file_over_two_gigabytes(spark, tmp_path):
    size = 3 << 30
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)  # sparse
    (tmp_path / "small").write_text("x")
    digest = hashlib.sha256()
    for _ in range(size >> 24):
        digest.update(bytes(1 << 24))
    got = {os.path.basename(r["path"]): r["sha256_hash"] for r in T.scan_hashes(spark, str(tmp_path)).collect()}
    assert got == {"large": digest.hexdigest(), "small": hashlib.sha256(b"x").hexdigest()}


def test_blocks_bound_the_memory(tmp_path):
    with open(tmp_path / "large", "wb") as f:
        f.truncate(1 << 30)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    T._digest(str(tmp_path / "large"))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10  # KB
