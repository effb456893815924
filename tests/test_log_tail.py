import os

import pyarrow as pa

from tidelane.sources import log_tail


def run(df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{name}-out").collect())


def add(folder, name, data):
    with open(f"{folder}/{name}", "ab") as f:
        f.write(data)


def lines_of(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        at = 0
        for line in open(f"{folder}/{name}", "rb").read().split(b"\n")[:-1]:
            out.append((f"{folder}/{name}", at, line.decode("utf-8", "replace").removesuffix("\r")))
            at += len(line) + 1
    return sorted(out)


def test_appended_lines_come_once_each_over_restarts(spark, tmp_path):
    folder = f"{tmp_path}/logs"
    os.mkdir(folder)
    add(folder, "a.log", b"one\ntwo\r\n\nhalf a li")
    stream = lambda: log_tail.tail(spark, f"file://{folder}", 7)
    first = run(stream(), tmp_path, "x")
    assert [r[2] for r in first] == ["one", "two", ""]
    add(folder, "a.log", "ne, é\nand ".encode())
    add(folder, "b.log", b"other \xff\n" + b"".join(b"%d\n" % i for i in range(300)))
    second = run(stream(), tmp_path, "x")
    assert second == lines_of(folder) and len(second) == 305
    assert run(stream(), tmp_path, "x") == second
    add(folder, "a.log", b"so on\n")
    assert run(stream(), tmp_path, "x") == lines_of(folder)


def test_lines_appended_between_triggers_of_one_query(spark, tmp_path):
    folder = f"{tmp_path}/logs"
    os.mkdir(folder)
    add(folder, "a.log", b"2024-01-01 00:00:00,001 | INFO | api | up\nno log line\n")
    q = log_tail.tail_logs(spark, f"file://{folder}").select("level", "message").writeStream.format("memory").queryName("tailed").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        for i in range(3):
            add(folder, "a.log", b"2024-01-01 00:00:0%d,001 | ERROR | api | down | %d\n" % (i, i))
            q.processAllAvailable()
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("tailed").collect()] == [("INFO", "up"), *(("ERROR", f"down | {i}") for i in range(3))]


def test_parts_and_replaced_files(tmp_path):
    folder = f"{tmp_path}/logs"
    os.mkdir(folder)
    text = b"".join(b"%s\n" % (b"x" * (i * 37 % 23)) for i in range(200)) + b"y" * 200_000 + b"\nlast\n"
    add(folder, "a.log", text)
    for size in (1, 5, 64, 100_000):
        reader = log_tail.LogTailReader({"path": f"file://{folder}", "splitbytes": str(size)} if size > 1 else {"path": f"file://{folder}/a.log", "splitbytes": "911"})
        end = reader.latestOffset()
        got = [(r["at"], r["value"]) for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p) for r in pa.Table.from_batches([b]).to_pylist()]
        assert got == [r[1:] for r in lines_of(folder)]
    assert reader.partitions(end, reader.latestOffset()) == []
    open(f"{folder}/a.log", "wb").write(b"new\n")
    (part,) = reader.partitions(end, reader.latestOffset())
    assert [b.to_pylist()[0]["value"] for b in reader.read(part)] == ["new"]
