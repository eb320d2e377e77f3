"""A source tree in a local store: what its files cost, and the same rows as in a store that only Spark reaches."""

from __future__ import annotations

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import source
from tracewright.sources import files
from tracewright.workloads import readers

OLD_DECLARATION = (
    r"(?U)(/\*\*[\s\S]*?\*/)?\s*"
    r"(?:function\s+(\w+)|const\s+(\w+)\s*=\s*\([^)]*\)\s*=>|(\w+)\s*:\s*function\s*\([^)]*\))"
)
PAGES = [
    (1, "https://h.test/en/1", "<p>1</p>"),
    (2, "https://h.test/de/2", "<p>2</p>\r\n<b>é</b>"),
    (3, "https://h.test/fr/3", "left out"),
    (4, None, "no address"),
    (5, "https://h.test/es/5", None),
    (6, "https://h.test/es/6", "once\nmore"),
    (6, "https://h.test/es/6", "once\nmore"),
    (None, "https://h.test/en/7", "no number"),
    (None, "https://h.test/en/8", "no number"),
]


def _index(spark, tmp_path, monkeypatch, rows, name):
    folder, root = tmp_path / f"{name}-tables", tmp_path / name
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(folder / "pages.parquet"))
    monkeypatch.setattr(readers, "scratch_path", lambda session, label: str(root))
    got = readers.source_tree_index(spark, str(folder)).collect()
    return sorted((r["path"], r["size"], r["lines"]) for r in got), root / "src"


def test_a_page_costs_one_file(spark, tmp_path, monkeypatch):
    got, tree = _index(spark, tmp_path, monkeypatch, [(i, f"https://h.test/en/{i}", f"<p>{i}</p>") for i in range(50)], "tree")
    made = [os.path.join(at, name) for at, _, names in os.walk(tmp_path / "tree") for name in names if "documents" not in at]
    folders = [at for at, _, _ in os.walk(tmp_path / "tree") if "documents" not in at]
    assert len(got) == len(made) == 50 and len(folders) == 3  # tree, src and libs; nothing of the tasks is left
    assert all(name.startswith(str(tree / "folder=libs" / "name=p")) for name in made)


def test_stores_give_the_same_rows(spark, tmp_path, monkeypatch):
    here, _ = _index(spark, tmp_path, monkeypatch, PAGES, "here")
    with monkeypatch.context() as elsewhere:
        elsewhere.setattr(files, "local_path", lambda session, folder: None)
        there, tree = _index(spark, tmp_path, elsewhere, PAGES, "there")
    assert here == there and (tree / "folder=libs" / "name=p1.ts").is_dir()
    none = files.NO_NAME
    assert [r[0] for r in here] == [f"src/{none}/{none}", "src/libs/p1.ts", "src/pages/p2.tsx", "src/pages/p4.ts", "src/pages/p5.ts", "src/pages/p6.ts"]
    lines = {r[0]: r[2] for r in here}
    assert lines["src/pages/p6.ts"].count("once") == 2 and "page6." not in lines["src/pages/p4.ts"] == lines["src/pages/p5.ts"] == ""


def test_files_are_not_a_task_each_few(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"f{i}.ts").write_text(f"{i}")
    tree = files.read_source_tree(spark, str(tmp_path))
    assert tree.rdd.getNumPartitions() <= max(1, spark.sparkContext.defaultParallelism)
    assert {r["content"] for r in tree.collect()} == {str(i) for i in range(600)}


@pytest.mark.parametrize("packed", [False, True])
def test_readers_agree_on_odd_names(spark, tmp_path, monkeypatch, packed):
    texts = {
        "x/a b+c%20.ts": b"1", "x/\xe9{a}.ts": b"a\xffb\xef\xbf\xbdc", "x/q.ts.part-00001": b"line\r\n", "x/empty.ts": b"", "x/.hidden": b"h",
        "x/_hidden": b"h", "x/_shown=1": b"s", "x/_metadata": b"m", "x/c._COPYING_": b"c", "_metadata/z": b"z", "_q/z": b"q", ".q/z": b"q", "p=1/z": b"p",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    if packed:
        (tmp_path / "x" / "g.ts.gz").write_bytes(gzip.compress(b"unpacked"))
    read = lambda: sorted(tuple(r) for r in files.read_source_tree(spark, str(tmp_path)).collect())
    here = read()
    monkeypatch.setattr(files, "local_path", lambda session, folder: None)
    assert here == read() and len(here) == 6 + packed
    assert ("unpacked" in dict(here).values()) == packed


def test_a_task_that_runs_again_leaves_the_same_files(spark, tmp_path, monkeypatch):
    class Context:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 3)  # noqa: N815

    monkeypatch.setattr(files, "TaskContext", Context)
    rows = files.pa.RecordBatch.from_pydict({"path": ["src/a/x", "src/a/x", "src/b/y"], "content": [b"1", None, b"2"]})
    ended = files._write_files(str(tmp_path), iter([rows.slice(0, 1), rows.slice(1)]))
    assert [b.to_pydict() for b in ended] == [{"files": [2]}]

    def broken():
        yield rows
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        list(files._write_files(str(tmp_path), broken()))
    found = {os.path.relpath(name, tmp_path): open(name, "rb").read() for name in files._files_below(str(tmp_path))}
    assert found == {"src/a/x.part-00003": b"1\n\n", "src/b/y.part-00003": b"2\n"}


def test_declarations_are_those_of_the_plain_expression(spark):
    pick = random.Random(4)
    bits = ["function", "const", " ", "  ", "\n", "\t", ":", "=", "=>", "(", ")", "a", "b1", "_", "é", "́", "\U00010400", "‍", " ", "/**", "*/", "*", "/", "?", "x: function(a)", "function go", "const f = (a) =>"]
    texts = [("".join(pick.choices(bits, k=pick.randint(1, 30))),) for _ in range(4000)]
    rows = spark.createDataFrame(texts, "t string")
    groups = lambda pattern: F.array(*[F.regexp_extract_all("t", F.lit(pattern), F.lit(g)) for g in range(5)])
    both = rows.select("t", groups(OLD_DECLARATION).alias("old"), groups(source.DECLARATION).alias("new"))
    assert both.filter("old != new").collect() == []
    assert both.filter("size(old[0]) > 0").count() > 500
