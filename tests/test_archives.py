"""Archives: members with their bytes, damaged ones marked, equal rows in equal bytes."""

import zipfile

from pagemill.sources import archives


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", b"one")
        z.writestr("two.txt", b"second member")
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "b.zip").write_bytes(whole.replace(b"second member", b"second nember"))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    rows = {(r.archive[-5:], r.name): (r.data and bytes(r.data), r.ok) for r in archives.zip_members(spark, [f"{tmp_path}/{x}.zip" for x in "abc"]).collect()}
    assert rows == {
        ("a.zip", "x/one.txt"): (b"one", True), ("a.zip", "two.txt"): (b"second member", True),
        ("b.zip", "x/one.txt"): (b"one", True), ("b.zip", "two.txt"): (None, False), ("c.zip", None): (None, False),
    }


def test_tar_shards_are_reproducible(spark):
    rows = [(1, "b", b"2"), (1, "a", b"1"), (2, "c", None)]
    digests = [{r.shard: (r.n, r.sha1) for r in archives.tar_shards(spark.createDataFrame(x, "shard bigint, name string, data binary")).collect()} for x in (rows, rows[::-1])]
    assert digests[0] == digests[1] and digests[0][1][0] == 2


def test_members_are_chosen_in_the_directory_and_dealt_out(spark, tmp_path):
    rows = spark.range(300).selectExpr("id div 200 AS shard", "concat(if(id % 2 = 0, 'a/', 'b/'), id) AS name", "encode(repeat('x', int(id)), 'UTF-8') AS data")
    paths = sorted(r.path for r in archives.zip_shards(rows, str(tmp_path)).collect())
    assert [p[-10:] for p in paths] == ["000000.zip", "000001.zip"]
    whole = archives.zip_members(spark, paths, chunk=2_000)
    assert whole.count() == 300 and whole.rdd.getNumPartitions() > 10
    some = whole.filter("name LIKE 'a/%' AND size > 280 AND ok")
    assert sorted(r.size for r in some.collect()) == list(range(282, 300, 2))
    assert some.rdd.getNumPartitions() == 1
    # A second run writes the same bytes.
    before = [open(p, "rb").read() for p in paths]
    archives.zip_shards(rows, str(tmp_path)).collect()
    assert [open(p, "rb").read() for p in paths] == before


def test_a_store_that_fails_is_asked_again():
    asked = []

    def read():
        asked.append(1)
        if len(asked) < 3:
            raise OSError
        return "x"

    assert archives.tried(read) == "x" and len(asked) == 3
