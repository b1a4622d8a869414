import json
import time

from logloom.sources.formats import spring_boot
from logloom.streaming.follow import TailReader, assemble_stream, drain, tail

HEAD = "2026-09-24T10:00:0{}.000Z  INFO 1 --- [main           ] " + "a.B".ljust(40) + " : m{}"


def rows_of(reader, start, end):
    return [tuple(r.values()) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]


def test_tail_reads_whole_lines_and_starts_again_when_a_file_shrinks(tmp_path):
    f = tmp_path / "a.log"
    f.write_text("one\r\ntwo\nthr")
    r = TailReader({"path": str(f)})
    at = r.latestOffset()
    assert rows_of(r, r.initialOffset(), at) == [("a.log", 0, 0, "one"), ("a.log", 0, 5, "two")]
    f.write_text("one\r\ntwo\nthree\n")
    then = r.latestOffset()
    assert rows_of(r, at, then) == [("a.log", 0, 9, "three")] == rows_of(TailReader({"path": str(f)}), at, then)
    f.write_text("new\n")
    assert rows_of(r, then, r.latestOffset()) == [("a.log", 1, 0, "new")]
    # a reader that was started since the file shrank
    late = TailReader({"path": str(f)})
    assert rows_of(late, then, late.latestOffset()) == [("a.log", 1, 0, "new")]
    assert json.loads(late.latestOffset()[str(f)])["epoch"] == 1


def test_stretches_of_any_size_give_the_same_lines(tmp_path):
    f = tmp_path / "a.log"
    lines = ["", "é" * 7, "x" * 50, "", "end", "last\r"] * 3
    f.write_bytes("\n".join(lines).encode() + b"\nopen")
    whole = None
    for stretch in (1, 2, 7, 64, 1 << 20):
        r = TailReader({"path": str(f), "stretch": str(stretch)})
        got = rows_of(r, {}, r.latestOffset())
        whole = whole or got
        assert got == whole and [x[3] for x in got] == [x.removesuffix("\r") for x in lines]
    assert len(TailReader({"path": str(f), "stretch": "64"}).partitions({}, r.latestOffset())) > 3


def test_stream_assembles_and_flushes(spark, tmp_path):
    f = tmp_path / "a.log"
    f.write_text(HEAD.format(0, 0) + "\n  more\n" + HEAD.format(1, 1) + "\n")
    q = assemble_stream(tail(spark, str(f), 40), spring_boot, "2 seconds").writeStream.format("memory").queryName("events").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("events").count() < 2:
            time.sleep(1)
        with f.open("a") as g:
            g.write("late\n")
        while time.time() < end and spark.table("events").count() < 3:
            time.sleep(1)
        rows = sorted((r.sequence, r.line_number, r.line_count) for r in spark.table("events").collect())
        assert rows == [(0, 1, 2), (1, 3, 1), (2, 4, 1)]
    finally:
        q.stop()


def test_follow_into_a_table(spark, tmp_path):
    """Stopped with an open event, started again, and drained."""
    from logloom.sources.store import Merged
    from logloom.streaming.follow import follow

    f, table = tmp_path / "b.log", f"file://{tmp_path}/logs"
    f.write_text(HEAD.format(0, 0) + "\n  more\n" + HEAD.format(1, 1) + "\n")
    merged = Merged(spark, table, "log_id")

    def read():
        rows = merged.read()
        return [] if rows is None else sorted((r.sequence, r.line_number, r.line_count, r.message) for r in rows.collect())

    def start():
        return follow(tail(spark, str(f)), spring_boot, "d", lambda events: events, table, f"file://{tmp_path}/c", "2 seconds", "1 second")

    q = start()
    end = time.time() + 120
    while time.time() < end and len(read()) < 1 and q.exception() is None:
        time.sleep(0.5)
    q.stop()
    assert q.exception() is None, str(q.exception())[-3000:]
    with f.open("a") as g:
        g.write("  of it\n" + HEAD.format(2, 2) + "\n")
    drain(q, start, "2 seconds")
    got = read()
    assert got[0] == (0, 1, 2, "m0\n  more") and got[-1][1:] == (5, 1, "m2")
    assert [r[1:] for r in got[1:-1]] in ([(3, 2, "m1\n  of it")], [(3, 1, "m1"), (4, 1, "of it")])  # the timeout may come before the stop
