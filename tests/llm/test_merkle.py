import gzip

from pyspark.sql import functions as F

from tallyscope.llm import merkle as mk

SCHEMA = "file string, offset long, record binary, hash string, node long, level int"


def archive(spark, rows):
    return spark.createDataFrame([(f, o, r, "x", 1, 2) for f, o, r in rows], SCHEMA)


def records(files=3, count=40, size=300_000):
    return [(f"f{k}", n * size, f"{k}/{n} payload".encode()) for k in range(files) for n in range(count)]


def diff(left, right):
    return sorted((r.file, r.offset, r.status) for r in mk.audit(left, right).collect())


def test_finds_all_damage(spark):
    rows = records()
    damaged = {(f, o): r for f, o, r in rows}
    damaged["f0", 300_000] = b"flipped"
    del damaged["f1", 39 * 300_000]
    damaged["f1", 17] = b"extra"
    damaged["f9", 0] = b"new file"
    other = [(f, o, r) for (f, o), r in damaged.items()]
    assert diff(archive(spark, rows), archive(spark, other)) == [
        ("f0", 300_000, "changed"),
        ("f1", 17, "extra"),
        ("f1", 39 * 300_000, "missing"),
        ("f9", 0, "extra"),
    ]
    assert diff(archive(spark, rows), archive(spark, rows[::-1])) == []


def test_equals_plain_comparison(spark):
    a, b = records(2, 90, 1_000_003), [(f, o, r if o % 7 else r + b"!") for f, o, r in records(2, 90, 1_000_003)]
    expected = sorted((f, o, "changed") for (f, o, r), (_, _, s) in zip(a, b, strict=True) if r != s)
    assert diff(archive(spark, a), archive(spark, b)) == expected


def test_only_differing_branches_are_opened(spark):
    rows = records(1, 64, 1 << 20)
    leaves = mk.leaves(archive(spark, rows))
    levels = mk.levels_for(63 << 20)
    tree = mk.trees(leaves, levels)
    assert {r.level: r["count"] for r in tree.groupBy("level").count().collect()} == {0: 64, 1: 4, 2: 1}


def test_odd_rows(spark):
    rows = [("f", 0, None), ("f", 5, b""), (None, 3, b"x"), ("f", None, b"x"), ("f", -1, b"x")]
    copies = [("f", 9, b"same")] * 50
    assert diff(archive(spark, rows + copies), archive(spark, rows + copies)) == []
    assert diff(archive(spark, rows + copies), archive(spark, rows + copies[1:])) == [("f", 9, "changed")]
    assert diff(archive(spark, []), archive(spark, [])) == []
    assert diff(archive(spark, rows[:1]), archive(spark, [])) == [("f", 0, "missing")]


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, None, None), (3, "http://c/", "x\r\n\r\ny")], "id int, url string, html string")
    rows = pages.select("id", mk.warc_record(F.col("url"), F.col("id"), F.col("html")).alias("record")).orderBy("id").collect()
    data = [bytes(r.record) for r in rows]
    (tmp_path / "plain.warc").write_bytes(b"".join(data))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data))
    (tmp_path / "none.warc").write_bytes(b"")
    found = mk.read_warc(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [bytes(r.record) for r in found if r.file == "plain.warc"] == data
    assert [bytes(r.record) for r in found if r.file == "packed.warc.gz"] == data
    assert [r.offset for r in found if r.file == "plain.warc"] == [0, len(data[0]), len(data[0]) + len(data[1])]
    (tmp_path / "plain.warc").write_bytes(data[0] + data[1].replace(b"Length: 0", b"Length: ?") + data[2])
    again = mk.read_warc(spark, str(tmp_path / "plain.warc"))
    assert again.count() == 2


def test_a_changed_copy_between_others(spark):
    hashed = lambda names: spark.createDataFrame([("f", 0, n) for n in names], "file string, offset long, leaf string")
    leaf = lambda names: mk.merged_leaves(hashed(names)).first().leaf
    assert leaf("abd") != leaf("acd") and leaf("aabd") != leaf("abbd") and leaf("abd") == leaf("dba")


def test_damaged_members_stay_records(tmp_path):
    """A changed byte in a compressed file never stops the reader; the records before it are whole."""
    records = [f"record {k} ".encode() * 50 for k in range(30)]
    members = [gzip.compress(r, mtime=0) for r in records]
    whole = b"".join(members)
    starts = [sum(map(len, members[:k])) for k in range(30)]
    assert list(mk._members(whole)) == list(zip(starts, records, strict=True))
    for at in (0, 3, starts[5] + 1, starts[7] + 14, starts[29] - 3, len(whole) - 1):
        damaged = bytearray(whole)
        damaged[at] ^= 0xFF
        found = list(mk._members(bytes(damaged)))
        good = sum(start + len(member) <= at for start, member in zip(starts, members, strict=True))
        assert found[:good] == list(zip(starts, records, strict=True))[:good]
        assert found != list(mk._members(whole))
    assert list(mk._members(whole[:-5]))[-1] == (starts[29], members[29][:-5])
    long = b"".join(gzip.compress(b"x", mtime=0) for _ in range(20_000))
    assert len(list(mk._members(long))) == 20_000
