"""The parallel CSV reader against Spark's one-task reader, with files cut at every byte."""

import os
import random
import tempfile

import pytest

from parley.sources import csv_records as R

CASES = {
    "plain": "a,b\n1,x\n2,y\n",
    "no line end at the end": "a,b\n1,x\n2,y",
    "quoted newlines": 'a,b\n1,"x\ny"\n"2\n\n3","z ""q"" \n"\n4,w\n',
    "quotes at line ends": 'a,b\n"""",""""\n"""\n""",""\n,\n"x","\n\n\n"\n',
    "carriage returns": 'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n',
    "empty lines": 'a,b\n\n1,x\n\n\n2,"\n"\n\n',
    "unicode": 'a,b\né,"ü\n🙂"\n"漢字",x\n',
    "short and long rows": "a,b\n1\n1,2,3\n",
    "header only": "a,b\n",
    "quoted header": '"a","b\nc"\n1,2\n',
}


def folder(files):
    path = tempfile.mkdtemp(prefix="parley-csv-")
    for name, text in files.items():
        with open(os.path.join(path, name), "w", newline="") as f:
            f.write(text)
    return path


@pytest.fixture
def ranges(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {k: spark.conf.get(k) for k in keys}

    def set_to(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], 1)

    yield set_to
    for k, v in old.items():
        spark.conf.set(k, v)


def one_task(spark, path):
    return [tuple(r) for r in spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').collect()]


def many_tasks(spark, path):
    rows = sorted(R.read_csv(spark, path).collect(), key=lambda r: r["position__"])
    assert [r["position__"] for r in rows] == list(range(len(rows)))
    return [tuple(r)[:-1] for r in rows]


@pytest.mark.parametrize("name", CASES)
def test_cut_at_every_byte(spark, ranges, name):
    path = folder({"one.csv": CASES[name]})
    want = one_task(spark, path)
    ranges(1)
    assert R.lines(spark, path).rdd.getNumPartitions() > 1
    assert many_tasks(spark, path) == want


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_several_files_and_sizes(spark, ranges, size):
    rng = random.Random(size)
    fields = ["", "x", "a b", "q\"q", "n\nn", "\n", "c,c", "é🙂", "\"", "\n\n\"\n"]

    def field():
        f = rng.choice(fields)
        return '"' + f.replace('"', '""') + '"' if set(f) & set('",\n') or rng.random() < 0.3 else f

    files = {f"f{k}.csv": "a,b,c\n" + "".join(f"{k}-{i},{field()},{field()}\n" for i in range(60)) for k in range(3)}
    want = [r for name in sorted(files) for r in one_task(spark, folder({name: files[name]}))]
    path = folder(files)
    ranges(size)
    assert many_tasks(spark, path) == want


def test_without_broadcast(spark, ranges, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST", 0)
    path = folder({"one.csv": CASES["quoted newlines"]})
    want = one_task(spark, path)
    ranges(5)
    assert many_tasks(spark, path) == want


def test_changed_ranges_raise(spark, ranges):
    path = folder({"one.csv": CASES["plain"]})
    df = R.read_csv(spark, path)
    ranges(3)
    with pytest.raises(Exception, match="ranges changed"):
        df.collect()


def test_summary_and_cutter_agree_on_every_split():
    rng = random.Random(1)
    for _ in range(300):
        of = ["".join(rng.choices('a",\r', k=rng.randint(0, 4))) for _ in range(8)]
        for inside in (False, True):
            s, c = R.Summary(), R.Cutter(inside)
            for line in of:
                s.feed(line)
            ended = sum(c.feed(line) is not None for line in of)
            assert ended == s.ends[inside] and (c.rest() is not None) == (c.odd and bool(of))
