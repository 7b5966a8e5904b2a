import gzip
import os

import pytest
from folioscope.plans import queries
from folioscope.sinks import scratch
from folioscope.sinks.tree import remove_tree, write_tree
from folioscope.sources import markdown, tables

ROWS = [
    ("en", "1", "a\nb"), ("en", "2", ""), ("en", "3", None), ("en", "3", "again\n"), (None, "1", "no category"), ("", "1", "nor here"),
    ("fr", None, "no stem"), ("a/b=c%d", "é \n+[^{}]*?#:\\'\"\x7f", "odd \r\n"), ("en", "3", "and again"), ("_x", ".y", "é"),
]


def files_of(root):
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".txt"):
                with open(os.path.join(folder, name), "rb") as file:
                    found.setdefault(os.path.relpath(folder, root), []).append(file.read())
    return found


def test_a_written_tree_is_that_of_sparks_writer(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "category string, stem string, value string").coalesce(1)
    rows.write.partitionBy("category", "stem").text(f"{tmp_path}/spark")
    write_tree(rows, f"{tmp_path}/own", "category", "stem")
    got = files_of(tmp_path / "own")
    assert got == files_of(tmp_path / "spark") and len(got) == 7
    assert got["category=en/stem=3"] == [b"\nagain\n\nand again\n"]
    assert not [n for _, _, names in os.walk(tmp_path / "own") for n in names if not n.startswith("part-")]
    remove_tree(spark, f"{tmp_path}/own")
    assert not os.path.exists(tmp_path / "own") and os.path.exists(tmp_path / "spark")


def test_nothing_to_write_is_an_empty_tree(spark, tmp_path):
    rows = spark.createDataFrame([], "category string, stem string, value string")
    write_tree(rows, f"{tmp_path}/none", "category", "stem")
    assert os.listdir(tmp_path / "none") == []
    remove_tree(spark, f"{tmp_path}/none")
    assert not os.path.exists(tmp_path / "none")


def test_rows_of_one_folder_in_several_tasks_are_several_files(spark, tmp_path):
    rows = spark.createDataFrame([("en", "1", str(i)) for i in range(8)], "category string, stem string, value string")
    write_tree(rows.repartitionByRange(4, "value"), f"{tmp_path}/t", "category", "stem")
    assert sorted(files_of(tmp_path / "t")["category=en/stem=1"]) == [b"0\n1\n", b"2\n3\n", b"4\n5\n", b"6\n7\n"]


@pytest.mark.parametrize("pattern", ["*.md", "[!b]*.{md,txt}", "a.md", "?+*.md"])
def test_listing_finds_what_sparks_does(spark, tmp_path, monkeypatch, pattern):
    root = tmp_path / "my docs+%41 x"
    names = [
        "a.md", "b.md", "a.txt", "c.md.bak", "top/a.md", "top/_a.md", "top/.a.md", "top/_k=v.md", "top/a.md._COPYING_", "top/e/e/e/deep.md",
        "_off/a.md", ".off/a.md", "_k=v/a.md", "_metadata/a.md", "_metadata.md", "off._COPYING_/a.md", "p+q %41.md", "p+q %41/é.md",
    ]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(f"{name}\r\n\n".encode() + b"\xff")
    (root / "empty.md").touch()
    (root / "dir.md").mkdir()
    (root / "link.md").symlink_to(root / "a.md")
    (root / "gone.md").symlink_to(root / "no such")
    (root / "linked").symlink_to(root / "top")

    def found():
        rows = tables.read_tree(spark, f"{root}/", pattern).selectExpr("path", "hex(cast(text as binary)) AS text").collect()
        return sorted((r.path, r.text) for r in rows)

    own = found()
    monkeypatch.setattr(tables, "local_folder", lambda *_: None)
    assert own == found() and own


def test_packed_files_and_missing_folders_are_left_to_spark(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "part-0.gz").write_bytes(gzip.compress(b"whole\n"))
    assert [r.text for r in tables.read_tree(spark, str(tmp_path), "part-*").collect()] == ["whole\n"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_tree(spark, f"{tmp_path}/none", "*.md")


def test_tasks_do_not_follow_the_number_of_files(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"c{i % 3}" / f"s{i}").mkdir(parents=True)
        (tmp_path / f"c{i % 3}" / f"s{i}" / "a.md").write_text(str(i))
    found = tables.read_tree(spark, str(tmp_path), "*.md")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(int(r.text) for r in found.collect()) == list(range(200))


def test_scanned_documents_have_their_tree_in_parts(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "kept")
    monkeypatch.setattr(scratch, "_folder", lambda _: folder)
    rows = [(i, f"# T{i}\n\nbody {i}\n", "en") for i in range(40)] + [(None, None, None), (None, "null too", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: (r.title, r.description) for r in queries.corpus_scan(spark, str(tmp_path)).collect()}
    none = "__HIVE_DEFAULT_PARTITION__"
    assert got == {f"en/{i}.md": (f"T{i}", f"body {i}") for i in range(40)} | {f"{none}/{none}.md": (none, "null too")}
    assert 0 < sum(map(len, files_of(folder).values())) < 41  # not all at once


def test_scanning_no_documents_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_folder", lambda _: str(tmp_path / "kept"))
    spark.createDataFrame([], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(markdown.EmptyCorpusError):
        queries.corpus_scan(spark, str(tmp_path))
