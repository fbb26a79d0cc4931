"""Quoted CSV files cut into byte ranges, against Python's own reader."""

import csv
import io
import os
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docvec.sources.corpus import read_csv_corpus
from docvec.sources.quoted_csv import _pieces, ends_inside, quoted_records

TRICKY = ('1,"a ""b"" c",d\n2,"line\nline\n\nline, ""x""",\n\n3,"""",""\n4,pl"ain,"q"\r\n5,"' + "long\n" * 60 + '",end\n'
          '6,"","é\n""\n"\n7,"x""\n",y\n8,,\n')


def plain(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.fixture
def splits_of(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [7, 33, 200, 1 << 20])
def test_ranges_of_any_size(spark, splits_of, size):
    d = tempfile.mkdtemp(prefix="docvec-csv-")
    with open(os.path.join(d, "a.csv"), "w", newline="") as f:
        f.write(TRICKY)
    splits_of(size)
    out, n = quoted_records(spark, os.path.join(d, "a.csv"))
    rows = sorted(out.collect())
    assert [r["fields"] for r in rows] == plain(TRICKY) and [r["record"] for r in rows] == list(range(n))
    if size < 100:  # a file of several ranges is read by several tasks
        assert spark.read.text(os.path.join(d, "a.csv")).rdd.getNumPartitions() > 4


def test_folder_open_quote_and_empty_files(spark, splits_of):
    d = tempfile.mkdtemp(prefix="docvec-csv-")
    for name, text in (("a.csv", '1,"x\n2,"y'), ("b.csv", ""), ("c.csv", '3,z\n4,"open\nto the end')):
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)
    splits_of(5)
    out, n = quoted_records(spark, d)
    rows = sorted(out.collect())
    assert n == 3 and [r["fields"] for r in rows] == [["1", "x\n2,y"], ["3", "z"], ["4", "open\nto the end"]]
    empty, none = quoted_records(spark, os.path.join(d, "b.csv"))
    assert none == 0 and empty.collect() == []


def test_corpus_order_targets_and_missing_texts(spark, splits_of):
    d = tempfile.mkdtemp(prefix="docvec-csv-")
    for name, text in (("test.csv", '2,"a\nb",c\nx,"d"\n'), ("train.csv", "1,e,f,g,more\n")):
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)
    splits_of(4)
    rows = read_csv_corpus(spark, d).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["target"]) for r in rows] == [(0, "a\nbc", 1), (1, "d", None), (2, "efg", 0)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='",a\n', max_size=40), st.integers(0, 12))
def test_cases_follow_the_reader(text, cut):
    lines = [x.encode() for x in text.split("\n")]
    if lines[-1] == b"":
        lines.pop()
    records = [b"\n".join(own).decode() for _, own, _ in _pieces(lines, False, 0)]
    got = [f for r in records for f in csv.reader([r])]
    assert got == [r for r in csv.reader([x + "\n" for x in text.split("\n")][:len(lines)]) if r] or _open_end(lines)
    # the two halves of a file give the same records as the whole
    head, tail = lines[:cut], lines[cut:]
    inside = False
    for line in head:
        inside = ends_inside(line, inside)
    a, b = list(_pieces(head, False, 0)), list(_pieces(tail, inside, 1 + max([r for r, _, _ in _pieces(head, False, 0)], default=-1)))
    joined = {}
    for r, own, _ in a + b:
        joined.setdefault(r, []).extend(own)
    assert [b"\n".join(joined[r]).decode() for r in sorted(joined)] == records


def _open_end(lines):
    inside = False
    for line in lines:
        inside = ends_inside(line, inside)
    return inside  # the reader keeps the last line break of a field that stays open
