"""Text files, whole runs, sinks, streams and the command line."""

import io
import json

import pytest
from pyspark.sql import functions as F

from linesieve import cli
from linesieve.options import DedupOptions, file_capacity, stream_error
from linesieve.plans import pipeline, sinks
from linesieve.sources.text import column_lines, read_lines, stream_lines
from linesieve.streaming import dedup

CASES = {
    "empty": (b"", []),
    "single": (b"a\n", ["a"]),
    "repeat": (b"a\nb\na\na\nb\n", ["a", "b"]),
    "no_final_newline": (b"a\nb\na", ["a", "b"]),
    "crlf": (b"b\r\nb\nb\r\n", ["b\r", "b"]),
    "blank": (b"\n\nx\n\n", ["", "x"]),
    "nul": (b"q\0z\nq\0y\n", ["q\0z", "q\0y"]),
    "utf8": ("é\né\n".encode(), ["é", "é"]),
    "case_space": (b"A\na\na \n", ["A", "a", "a "]),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("method", ["exact", "bloom", "scaling", "partitioned"])
def test_fixture_files(spark, tmp_path, name, method):
    raw, want = CASES[name]
    path = tmp_path / f"{name}.txt"
    path.write_bytes(raw)
    lines = read_lines(spark, str(path))
    got = pipeline.run(lines, DedupOptions(method=method, error_rate=1e-6, capacity=1000)).orderBy("ord")
    assert [r["line"] for r in got.collect()] == want


def test_numbering_over_blocks_and_files(spark, tmp_path):
    a, b = tmp_path / "b a+1%.txt", tmp_path / "a.txt"
    a.write_text("".join(f"line {i} {'x' * 50}\n" for i in range(5000)))
    b.write_text("z\nlast")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read_lines(spark, [str(a), str(b)]).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["ord"] for r in got] == list(range(1, 5003))
    assert [r["line"].split(" ")[1] for r in got[:5000]] == [str(i) for i in range(5000)]
    assert [r["line"] for r in got[5000:]] == ["z", "last"]
    assert [r["had_newline"] for r in got] == [True] * 5001 + [False]


def test_guards(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("aaaa\n")
    with pytest.raises(ValueError):
        read_lines(spark, str(path), max_input_bytes=3)
    with pytest.raises(ValueError):
        read_lines(spark, f"{tmp_path}/../x.txt")
    with pytest.raises(FileNotFoundError):
        read_lines(spark, str(tmp_path / "none.txt"))


@pytest.mark.parametrize("n,unique", [(8190, 2), (8191, 2), (8192, 1)])
def test_long_lines(spark, tmp_path, n, unique):
    path = tmp_path / "long.txt"
    path.write_text("x" * n + "\n" + "x" * (n - 1) + "y\n")
    lines = read_lines(spark, str(path))
    assert pipeline.run(lines).count() == 2
    assert pipeline.run(lines, DedupOptions(max_line_bytes=8191)).count() == unique


def test_modes_and_strict(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "a", True), (4, None, True), (5, None, True), (6, "b", False)], "ord bigint, line string, had_newline boolean")
    run = lambda **o: sorted(map(tuple, pipeline.run(df, DedupOptions(**o)).collect()), key=str)
    assert run() == sorted([("a", 1), ("b", 2), (None, 4)], key=str)
    assert run(mode="duplicates") == sorted([("a", 3), (None, 5), ("b", 6)], key=str)
    assert run(mode="once") == [] and len(run(mode="groups")) == 3
    assert run(mode="counts") == sorted([("a", 1, 2), ("b", 2, 2), (None, 4, 2)], key=str)
    assert ("b", 6) in run(strict_newline=True)
    assert run(limit=1) == [("a", 1)]
    assert run(method="auto") == run()


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "ord bigint, line string")
    path = str(tmp_path / "model")
    pipeline.run(df, DedupOptions(save_model=path)).count()
    more = spark.createDataFrame([(3, "b"), (4, "c"), (5, "c")], "ord bigint, line string")
    assert [tuple(r) for r in pipeline.run(more, DedupOptions(load_model=path)).collect()] == [("c", 4)]


@pytest.mark.parametrize("method", ["exact", "scaling"])
def test_save_and_load_together_extend(spark, tmp_path, method):
    a, b, path = tmp_path / "a", tmp_path / "b", str(tmp_path / "a")
    frame = lambda *x: spark.createDataFrame(list(enumerate(x, 1)), "ord bigint, line string")
    run = lambda df, **o: {r["line"] for r in pipeline.run(df, DedupOptions(method=method, capacity=1000, error_rate=1e-4, **o)).collect()}
    assert run(frame("a", "b"), save_model=path) == {"a", "b"}
    assert run(frame("b", "c"), load_model=path, save_model=str(b)) == {"c"}
    assert run(frame("a", "b", "c", "d"), load_model=str(b)) == {"d"}
    assert run(frame("c", "d"), load_model=str(b), save_model=str(b)) == {"d"}
    assert run(frame("a", "d", "e", "e"), load_model=str(b)) == {"e"}
    counts = pipeline.run(frame("a", "e", "e"), DedupOptions(mode="counts", load_model=str(b))).collect()
    assert [(r["line"], r["cnt"]) for r in counts] == [("e", 2)]
    assert a.exists()


@pytest.mark.parametrize("raw,ends", [(b"\xef\xbb\xbfa\nb\n", True), (b"\xef\xbb\xbfa\nb", False), (b"\xff\n\xc3", False), (b"\n", True), (b"a\r\n", True)])
def test_last_newline(spark, tmp_path, raw, ends):
    (tmp_path / "f.txt").write_bytes(raw)
    got = read_lines(spark, str(tmp_path / "f.txt")).orderBy("ord").collect()
    assert [r["had_newline"] for r in got] == [True] * (len(got) - 1) + [ends]


@pytest.mark.parametrize("bad", [{"mode": "x"}, {"method": "x"}, {"fmt": "x"}, {"family": "x"}, {"error_rate": 0}, {"error_rate": 1}, {"capacity": 10}, {"num_buckets": 0}, {"limit": 0}, {"method": "scaling", "mode": "counts"}])
def test_bad_options(bad):
    with pytest.raises(ValueError):
        DedupOptions(**bad)


def test_capacity_policy():
    assert [file_capacity(n) for n in (0, 2000 * 20, 10**12)] == [1000, 3000, 10_000_000]
    assert stream_error(0.001) == 0.01 and stream_error(0.1) == 0.1


@pytest.mark.parametrize("fmt", ["text", "json", "csv", "tsv"])
def test_sinks(spark, tmp_path, fmt):
    lines = ['q"uote', "back\\slash", "tab\t", "plain", "ünï"]
    df = spark.createDataFrame(list(enumerate(lines)), "ord bigint, line string")
    path = str(tmp_path / fmt)
    sinks.write(df, path, fmt)
    if fmt == "json":
        got = [json.loads(r[0])["line"] for r in spark.read.text(path).collect()]
    elif fmt == "csv":
        got = [r["line"] for r in spark.read.csv(path, header=True, escape='"').collect()]
    else:
        got = [r[0] for r in spark.read.text(path).collect()]
    assert sorted(got) == sorted(lines)
    doc = json.loads("".join(sinks.json_document(df, {"total_lines": 5})))
    assert [x["line"] for x in doc["lines"]] == lines and doc["statistics"] == {"total_lines": 5}
    assert json.loads("".join(sinks.json_document(df.where("false"), {})))["lines"] == []


@pytest.mark.parametrize("fmt,want", [("text", ["2 a,\"b", "1 c"]), ("tsv", ["a,\"b\t2", "c\t1"]), ("csv", ["line,cnt", '"a,""b",2', '"c",1']), ("json", ['{"line":"a,\\"b","cnt":2}', '{"line":"c","cnt":1}'])])
def test_counts_in_every_format(spark, tmp_path, fmt, want):
    df = spark.createDataFrame([(1, "a,\"b", 2), (2, "c", 1)], "ord bigint, line string, cnt bigint")
    assert list(sinks.texts(df, fmt)) == want
    sinks.write(df, str(tmp_path / fmt), fmt)
    if fmt == "csv":
        got = [(r["line"], r["cnt"]) for r in spark.read.csv(str(tmp_path / fmt), header=True, escape='"').orderBy("line").collect()]
        assert got == [("a,\"b", "2"), ("c", "1")]
    else:
        assert sorted(r[0] for r in spark.read.text(str(tmp_path / fmt)).collect()) == sorted(want)


def test_column_lines(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, None), (3, "")], "d bigint, t string")
    assert [tuple(r) for r in column_lines(df, "t", "d").orderBy("d", "line_no").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (3, 1, "")]


def _drain(spark, df, tmp_path, name):
    df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text("".join(f"k{j % 300}\n" for j in range(i * 50, i * 50 + 400)))
    want = {f"k{j}" for j in range(300)}
    got = _drain(spark, dedup.unique_stream(stream_lines(spark, str(folder)), "line"), tmp_path, "exact")
    assert sorted(r[0] for r in got.collect()) == sorted(want)
    got = [r[0] for r in _drain(spark, dedup.bloom_unique_stream(stream_lines(spark, str(folder)), "line", 10_000, 0.01, 4), tmp_path, "bloom").collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want)
    timed = stream_lines(spark, str(folder)).withColumn("ts", F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    got = _drain(spark, dedup.unique_within(timed, "line", "ts", "1 hour"), tmp_path, "within")
    assert {r["line"] for r in got.collect()} == want


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    src = tmp_path / "in.txt"
    src.write_text("a\nb\na\n")
    assert cli.main([str(src)]) == 0
    assert capsys.readouterr().out.split() == ["a", "b"]
    assert cli.main([str(src), "-c"]) == 0
    assert capsys.readouterr().out.splitlines() == ["2 a", "1 b"]
    assert cli.main([str(src), "-D", "-s"]) == 0
    out = capsys.readouterr()
    assert out.out == "a\n" and json.loads(out.err.splitlines()[-1])["duplicate_lines"] == 1
    assert cli.main([str(src), "-s", "-c", "-f", "json"]) == 0
    doc = json.loads(capsys.readouterr().out)
    assert doc["lines"] == [{"line": "a", "cnt": 2}, {"line": "b", "cnt": 1}] and doc["statistics"]["total_lines"] == 3
    assert cli.main([str(src), "-b", "scaling", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.text(str(tmp_path / "o")).count() == 2
    assert cli.main([str(src), "-e", "7"]) == 2
    for args in ([], ["-"]):
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"".join(b"%d\n" % (i % 150) for i in range(300)))))
        assert cli.main(args) == 0
        assert capsys.readouterr().out.split() == [str(i) for i in range(150)]
    with pytest.raises(SystemExit):
        cli.main(["--version"])
