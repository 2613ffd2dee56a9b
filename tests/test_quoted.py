"""Delimited files from elsewhere against Python's csv and pandas, cut into ranges of a few bytes."""

import csv
import io
import random

import pandas as pd
import pytest

from tidemark.sources import files, quoted

CHARS = ['"', '"', '""', ",", "\n", "\r", "\r\n", "\\", "\\n", "a", "b c", "é", "😀", "1", ""]


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "96", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.csv").write_bytes(text.encode())
    return str(folder)


def by_csv(text, width):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return [[x if x != "" else None for x in (r + [None] * width)[:width]] for r in rows[1:]]


def test_random_files_as_csv_reads_them(spark, small_ranges, tmp_path):
    rng = random.Random(5)
    texts = {}
    for n in range(8):
        quoted_text = lambda: '"' + "".join(rng.choice(CHARS) for _ in range(rng.randrange(9))).replace('"', '""') + '"'
        plain = lambda: "".join(rng.choice(["a", "b\\", 'x"y', " ", "é", '5"', "\\n"]) for _ in range(rng.randrange(5)))
        rows = [[rng.choice([quoted_text, plain])() for _ in range(3)] for _ in range(14)]
        end = rng.choice(["\n", "\r\n", "\r", "\n\n"])
        texts[f"f{n}"] = end.join(["h1,h2,h3", *(",".join(r) for r in rows)]) + rng.choice(["", end])
    got = quoted.read_quoted(spark, write(tmp_path, **texts), "a string, b string, c string", missing=("",))
    want = [tuple(r) for t in texts.values() for r in by_csv(t, 3)]
    key = lambda r: tuple((x is None, x or "") for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_as_pandas_reads_it(spark, small_ranges, tmp_path):
    text = 'id,title,score\n1,"path C:\\new\\report",0.5\n2,"two\nlines, ""quoted""",NA\n\n3,"",x\n4,tail"quote,7\r\n5,"a"b,\n"6","\r\n",1e3\n'
    path = write(tmp_path, one=text)
    got = quoted.read_quoted(spark, path, "id int, title string, score double")
    want = pd.read_csv(io.StringIO(text, newline=""))
    rows = {r.id: (r.title, r.score) for r in got.collect()}
    assert rows.keys() == set(want["id"])
    for i, title, score in want.itertuples(index=False):
        number = pd.to_numeric(score, errors="coerce")
        assert rows[i] == (None if pd.isna(title) else title, None if pd.isna(number) else float(number))


def test_one_record_over_many_ranges_and_odd_headers(spark, small_ranges, tmp_path):
    long_text = "line of text\n" * 60
    texts = {
        "long": f'h1,h2\n1,"{long_text}"\n2,after\n', "head": f'"long\n{long_text}",h2\n3,"x\ny"\n', "blank": "\n" * 120 + "h1,h2\n4,z\n",
        "open": 'h1,h2\n5,"never closed\nand on', "empty": "", "only": "h1,h2", "bom": "\ufeff\"h1\",h2\n6,q\n", "short": "h1,h2\n7\n8,b,c,d\n",
    }
    got = quoted.read_quoted(spark, write(tmp_path, **texts), "a int, b string")
    want = {1: long_text, 2: "after", 3: "x\ny", 4: "z", 5: "never closed\nand on", 6: "q", 7: None, 8: "b"}
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    # The same rows when states are too many to be sent to every task.
    again = quoted.read_quoted(spark, str(tmp_path), "a int, b string", state_bytes=0)
    assert sorted(map(tuple, again.collect())) == sorted(want.items())


def test_no_file_is_read_whole_by_one_task(spark, small_ranges, tmp_path):
    body = "".join(f'{i},"a\n""b"" {i}"\n' for i in range(120))
    path = write(tmp_path, big="i,t\n" + body)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 15
    got = quoted.read_quoted(spark, path, "i int, t string").collect()
    assert sorted(map(tuple, got)) == [(i, f'a\n"b" {i}') for i in range(120)]


def test_written_here_or_elsewhere(spark, tmp_path):
    rows = [(1, 'path C:\\new\\report "x"', None), (2, "two\nlines\r\nand \\n", "y"), (3, " blank ", "z")]
    df = spark.createDataFrame(rows, "index long, title string, company string")
    plain = files.write_plain(df, str(tmp_path / "plain"))
    own = files.write_delimited(df, str(tmp_path / "own"))
    for back in (files.read_delimited(spark, plain, df.schema.simpleString()[7:-1].replace(":", " ")), files.read_escaped(spark, own, "index long, title string, company string")):
        assert sorted(map(tuple, back.collect())) == rows
