"""Records found split by split against readers of whole files."""

import csv
import io
import os
import random
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quarry.sources.csv_records import _along_records, csv_records, states
from quarry.sources.text import read_csv_text


def folder(files):
    d = tempfile.mkdtemp(prefix="quarry-csv-")
    for name, text in files.items():
        with open(os.path.join(d, name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return d


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_file_is_read_by_many_tasks(spark, small_splits):
    rng = random.Random(9)
    cells = ["plain", "", "a,b", 'say "x"', '"', '""', "two\nlines", "\n\n", 'end"\n', "x" * 300, ' 5" pipe ', "é\r\nü", ",\n\",\n"]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "one", "two, \n three", "four"])
    rows = [[str(i), *[rng.choice(cells) for _ in range(3)]] for i in range(600)]
    rows += [["600", "deep\n" * 900, "after", '"\n' * 800], ["601", "last", "", "row"]]
    writer.writerows(rows)
    d = folder({"x.csv": out.getvalue()})
    df = read_csv_text(spark, d, null_tokens=())
    assert csv_records(spark, d).select("split").distinct().count() > 20
    assert df.columns == ["id", "one", "two, \n three", "four"]
    assert rows_of(df) == sorted((tuple(c or None for c in r) for r in rows), key=repr)
    one_task = spark.read.options(header=True, multiLine=True, escape='"', quote='"').csv(d)
    assert one_task.count() == df.count()


def test_each_file_has_its_own_header(spark):
    d = folder({"a.csv": "a,b\n1,2\n3,\n", "b.csv": "b,a\n20,10\n", "c.csv": "﻿c,a,a\n7,8,9,surplus\n", "d.csv": "a,b\n",
                "e.csv": "\n\nb\n\n5\n\n", "f.csv": ""})
    df = read_csv_text(spark, d)
    assert df.columns == ["a", "b", "c", "a.1"]
    assert rows_of(df) == sorted([("1", "2", None, None), ("3", None, None, None), ("10", "20", None, None), ("8", None, "7", "9"),
                                  (None, "5", None, None)], key=repr)
    assert rows_of(read_csv_text(spark, d, multi_line=False)) == rows_of(df)


def test_literal_quotes_agree_with_pandas(spark, small_splits):
    text = 'k,v\n1,5" pipe\n2,"a""b"\n3,"x,\ny"\n4,it"s "odd"\n5,"q"\r\n6,"""\n"""\n' + "".join(f'{i},"l{i}\n"\n' for i in range(7, 200))
    d = folder({"x.csv": text})
    want = pd.read_csv(os.path.join(d, "x.csv"), dtype=object, keep_default_na=False)
    assert rows_of(read_csv_text(spark, d, null_tokens=())) == sorted(map(tuple, want.values.tolist()), key=repr)


def test_text_after_a_closing_quote_stays_as_written(spark):
    d = folder({"x.csv": 'k,v\n1,"a" tail\n2,b\n'})
    assert rows_of(read_csv_text(spark, d)) == [("1", '"a" tail'), ("2", "b")]


def test_unclosed_quote_takes_the_rest(spark, small_splits):
    d = folder({"x.csv": "a,b\n1,2\n3,\"open\n" + "line\n" * 400, "y.csv": "a,b\n4,5\n"})
    rows = rows_of(read_csv_text(spark, d))
    assert [r[0] for r in rows] == ["1", "3", "4"]
    assert rows[1][1].count("\n") >= 400


def test_nothing_to_read(spark):
    assert read_csv_text(spark, folder({"x.csv": ""})).count() == 0
    df = read_csv_text(spark, folder({"x.csv": "a;b\n"}), sep=";")
    assert (df.columns, df.count()) == (["a", "b"], 0)


def test_states_compose():
    rng = np.random.default_rng(7)
    for _ in range(50):
        to0, to1 = rng.random(30) < 0.4, rng.random(30) < 0.6
        for first in (False, True):
            now, want = first, []
            for a, b in zip(to0, to1, strict=True):
                want.append(now)
                now = bool(b if now else a)
            before, after = states(to0, to1, first)
            assert before.tolist() == want
            assert after[-1] == now


def test_lines_met_in_any_runs_make_every_record_once():
    """Records of one to five lines in two files, met in batches of any size and from any line on."""
    rng = random.Random(3)
    for _ in range(60):
        lines, want = [], {}
        for file in ("a", "b"):
            split, at = 0, 0
            for _ in range(rng.randrange(1, 15)):
                first, n = (split, at), rng.choice([1, 1, 2, 5])
                want[(file, *first)] = [f"{file}{split}.{at}.{i}" for i in range(n)]
                for i in range(n):
                    lines.append((file, split, at, f"{want[(file, *first)][i]}", i > 0, i < n - 1, *first))
                    split, at = (split + 700, 0) if rng.random() < 0.1 else (split, at + 1)
        cut = rng.randrange(len(lines))
        lines = lines[cut:] + lines[:cut]
        batches = []
        while lines:
            n = rng.choice([1, 2, 7, 40])
            head, lines = lines[:n], lines[n:]
            batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*head, strict=True)], names=[
                "file", "split", "at", "line", "in", "out", "first_split", "first_at"]))
        whole, pieces = {}, {}
        for b in _along_records(iter(batches)):
            for r in b.to_pylist():
                key = (r["file"], r["split"], r["at"])
                if r["record"] is not None:
                    assert r["piece"] is None and key not in whole
                    whole[key] = r["record"]
                else:
                    pieces.setdefault(key, []).append((r["piece_split"], r["piece_at"], r["piece"]))
        assert not whole.keys() & pieces.keys()
        whole |= {k: "\n".join(p[2] for p in sorted(v)) for k, v in pieces.items()}
        assert whole == {k: "\n".join(v) for k, v in want.items()}


def test_records_inside_a_split_are_not_shuffled(spark):
    """Records of several lines stay in their task: before, all their lines were dealt anew for every use."""
    d = folder({"x.csv": "a,b\n" + "".join(f'{i},"one\ntwo {i}\nthree"\n' for i in range(30000))})
    found = csv_records(spark, d)
    scans = [p for p in found.inputFiles()]
    parts = spark.read.parquet(*scans)
    assert found.count() == 30001
    assert parts.where("piece is not null").count() <= 2 * len(scans)
