"""Files by name and sheets in chunks: order, repeated and lost attempts, retries, overwriting."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.sources import files as W


def held(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in sorted(path.rglob("*")) if p.is_file() and not p.name.endswith(".crc")}


def test_files_by_name(spark, tmp_path):
    rows = spark.range(0, 500, 1, 7).select(F.concat(F.lit("dir/f"), (F.col("id") % 13).cast("string"), F.lit(".txt")).alias("file"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("content"), "id")
    extra = spark.createDataFrame([("../../up.bin", None, 0), (None, "x", 1)], "file string, content string, id long")
    W.write_files(rows.unionByName(extra), str(tmp_path / "a"), ["id"])
    got = held(tmp_path / "a")
    assert got == {f"dir/f{k}.txt": "".join(f"{i}\n" for i in range(k, 500, 13)).encode() for k in range(13)}
    W.write_files(spark.createDataFrame([("../../up.bin", b"\x00\xff"), ("dir/f1.txt", b"new")], "file string, content binary"), f"file://{tmp_path}/a", overwrite=False)
    more = held(tmp_path / "a")
    assert more["up.bin"] == b"\x00\xff" and more["dir/f1.txt"] == b"new" and len(more) == 14 and not list(tmp_path.glob("*.bin"))
    W.write_files(rows.limit(0), str(tmp_path / "a"), ["id"])
    assert held(tmp_path / "a") == {}


def test_repeated_and_lost_attempts_leave_each_file_once(tmp_path):
    writer = W.FilesWriter(str(tmp_path / "o"), False)
    rows = [Row(file="a", content="1"), Row(file="a", content="2"), Row(file="b", content="3")]

    def dies():
        yield rows[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    twice = [writer.write(iter(rows)) for _ in range(2)]  # a speculative copy of the same task
    writer.commit([twice[1], None, W.Written("nowhere")])
    assert held(tmp_path / "o") == {"a": b"12", "b": b"3"}
    again = W.FilesWriter(str(tmp_path / "o"), True)
    again.abort([again.write(iter(rows))])
    assert held(tmp_path / "o") == {"a": b"12", "b": b"3"}
    with pytest.raises(ValueError):
        writer.write(iter([rows[0], rows[2], rows[0]]))
    clash = W.FilesWriter(str(tmp_path / "o"), False)
    with pytest.raises(ValueError):
        clash.commit([clash.write(iter(rows[:1])), clash.write(iter(rows[:1]))])


def test_csv_of_each_drawing(spark, tmp_path):
    rows = spark.createDataFrame([("d/one.dxf", 2, 'say "a,b"', None), ("d/one.dxf", 1, "ä", 1.5), ("d/two.v2.dxf", 1, "line\nbreak", 2.0)], "drawing string, n int, text string, v double")
    W.write_csv_files(rows, str(tmp_path / "c"), ["n", "text", "v"], order=["n"])
    got = held(tmp_path / "c")
    assert got == {"one_raw_extract.csv": '﻿n,text,v\r\n1,ä,1.5\r\n2,"say ""a,b""",\r\n'.encode(), "two.v2_raw_extract.csv": '﻿n,text,v\r\n1,"line\nbreak",2.0\r\n'.encode()}


def test_image_files(spark, tmp_path):
    import numpy as np

    from plumbline.sources import images

    table = spark.createDataFrame([("x/y", 1, 2, [1, 2, 3, 4]), ("x/y", 2, 2, [5, 6, 7, 8]), ("z", 3, None, None)], "block string, ent int, width int, pixels array<int>")
    W.write_files(images.image_rows(table, "block", "ent"), str(tmp_path / "i"))
    got = held(tmp_path / "i")
    assert set(got) == {"x_y__001.png", "x_y__002.png"} and np.array_equal(images.grey(got["x_y__002.png"]), [[5, 6], [7, 8]])


def test_sheet_in_chunks(spark, tmp_path):
    W.register(spark)
    target = str(tmp_path / "sheet")
    rows = spark.range(0, 1000, 1, 4).select("id", F.concat(F.lit("r"), "id").alias("name"))
    save = lambda df, mode: df.write.format("plumbline_sheet").option("path", target).option("chunkRows", "90").mode(mode).save()
    save(rows, "append")
    save(rows.limit(5), "overwrite")
    save(rows, "append")
    cells = W.read_sheet(spark, target)
    assert cells.count() == 1005 and cells.select("headers").distinct().first()[0] == ["id", "name"]
    chunks = [json.loads(v) for v in held(tmp_path / "sheet").values()]
    assert sorted(len(c["rows"]) for c in chunks if c["mode"] == "append") == sorted([90, 90, 70] * 4)
    second = [c for c in chunks if len({x["job"] for x in chunks if x["job"] == c["job"]}) and c["mode"] == "append"]
    order = [r[0] for c in sorted(second, key=lambda c: c["number"]) for r in c["rows"]]
    assert order == list(range(1000)) and not (tmp_path / "sheet-staging").exists() or not any((tmp_path / "sheet-staging").iterdir())
    save(rows.limit(0), "overwrite")
    assert W.read_sheet(spark, target).count() == 0


class Flaky:
    """Fails the first tries of each chunk, sometimes after it has taken the chunk."""

    sent: list = []
    tries: dict = {}

    def __init__(self, target):
        self.folder = W.Folder(target)

    def send(self, chunk):
        n = self.tries[chunk["number"]] = self.tries.get(chunk["number"], 0) + 1
        if n == 2:
            self.folder.send(chunk)
        if n < 3:
            raise TimeoutError
        self.folder.send(chunk)
        self.sent.append(chunk["number"])


def test_retries_leave_each_chunk_once(tmp_path, monkeypatch):
    waits = []
    monkeypatch.setattr(W.time, "sleep", waits.append)
    options = {"path": str(tmp_path / "t"), "chunkRows": "2", "transport": f"{__name__}:Flaky", "base": "2"}
    writer = W.SheetWriter(["n"], True, options)
    monkeypatch.setattr(W, "with_retries", lambda send, chunk, tries, base: real(send, chunk, tries, base, waits.append))
    lost = writer.write(iter([Row(n=9)]))
    kept = writer.write(iter([Row(n=i) for i in range(5)]))
    assert lost.names and len(kept.names) == 3
    writer.commit([kept])
    chunks = [json.loads(v) for v in held(tmp_path / "t").values()]
    assert sorted((c["number"], c["mode"], c["rows"]) for c in chunks) == [(0, "replace", [[0], [1]]), (1, "append", [[2], [3]]), (2, "append", [[4]])]
    assert waits == [2.0, 4.0] * 3 and not (tmp_path / "t-staging" / writer.job).exists()

    def never(chunk):
        raise TimeoutError

    def broken(chunk):
        waits.append("broken")
        raise ValueError

    with pytest.raises(TimeoutError):
        real(never, {}, 4, 2.0, waits.append)
    with pytest.raises(ValueError):
        real(broken, {}, 4, 2.0, waits.append)
    assert waits[6:] == [2.0, 4.0, 8.0, "broken"]


real = W.with_retries
