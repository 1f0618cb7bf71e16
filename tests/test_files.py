"""Files in parts: numbered lines of many blocks, and chapters that appear on commit."""

import os

import pytest
from pyspark.sql import Row


from lectern.sources import dictionaries, sinks


def test_lines_are_numbered_through_blocks_and_files(spark, tmp_path):
    lines = [f"line {i}" if i % 7 else ("# note" if i % 2 else "  ") for i in range(4000)]
    for n, part in enumerate((lines[:1500], lines[1500:1501], lines[1501:])):
        (tmp_path / f"part-{n}").write_text("\n".join(part) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = dictionaries.text_lines(spark, f"file://{tmp_path}")
        rows = sorted((r.line_no, r.line) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == [(i, x) for i, x in enumerate(lines) if x.strip() and not x.startswith("#")]


def files_below(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_chapters_appear_on_commit_alone(tmp_path):
    writer = sinks._ChapterWriter(f"file://{tmp_path}/out")
    rows = [Row(book="1", file="0001_a.txt", content="é\n"), Row(book="2", file="0001_b.txt", content="")]
    lost, kept, empty = writer.write(iter(rows)), writer.write(iter(rows)), writer.write(iter([]))
    with pytest.raises(ZeroDivisionError):
        writer.write(Row(book="3", file="x", content=str(1 // 0)) for _ in range(1))
    assert lost.folder != kept.folder and all("/_attempts-" in f"/{x}" for x in files_below(tmp_path / "out"))
    writer.commit([kept, empty, None])
    found = files_below(tmp_path / "out")
    assert [x.split("/", 1)[1] for x in found] == ["1/0001_a.txt", "2/0001_b.txt"]
    assert (tmp_path / "out" / found[0]).read_text() == "é\n"
    other = sinks._ChapterWriter(f"file://{tmp_path}/out")
    other.abort([other.write(iter(rows))])
    assert files_below(tmp_path / "out") == found


def test_chapters_of_odd_names_come_back(spark, tmp_path):
    rows = [(1, 1, "A/b: c?", "x"), (1, 1, "A/b: c?", "y"), (1, 2, "", None), (None, 1, "Ü", "é\r\nz"), (2, 12, "n" * 300, "w " * 100_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "book_id long, chapter_no int, title string, content string, file int").repartition(3)
    folder = f"file://{tmp_path}/books"
    sinks.write_chapter_files(df, folder)
    got = sinks.read_chapter_files(spark, folder).collect()
    assert sorted((str(r.book_id), r.content) for r in got) == sorted((str(r[0]), r[3]) for r in rows if r[3])
    assert sum(len(names) for _, _, names in os.walk(tmp_path / "books")) == len(rows)
    assert all(len(r.file) < 130 for r in got)
    assert len({r.file for r in got if r.book_id == 1}) == 2
    sinks.write_chapter_files(df.limit(0), f"file://{tmp_path}/none")


def test_archived_chapters_come_back_in_few_files(spark, tmp_path):
    rows = [(b, c, "A/b: c?" if c % 2 else "Ü", None if c == 7 else f"é\r\n{b} {c}") for b in (None, 1, 2) for c in range(300)]
    rows += [(1, 1, "A/b: c?", "y"), (3, 1, "long", "w " * 400_000)]
    df = spark.createDataFrame(rows, "book_id long, chapter_no int, title string, content string").repartition(3)
    sinks.write_chapter_archives(df, f"file://{tmp_path}/zipped")
    got = sinks.read_chapter_archives(spark, f"file://{tmp_path}/zipped").collect()
    assert sorted((str(r.book_id), r.content) for r in got) == sorted((str(r[0]), r[3] or "") for r in rows)
    assert len({(r.book_id, r.file) for r in got}) == len(rows)
    assert len(files_below(tmp_path / "zipped")) <= 9
    sinks.write_chapter_archives(df.limit(0), f"file://{tmp_path}/none")


def test_archives_are_bounded_and_appear_on_commit(tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ARCHIVE_FILES", 2)
    writer = sinks._ArchiveWriter(f"file://{tmp_path}/out")
    rows = [Row(book="1", file=f"{n}.txt", content="é") for n in range(5)]
    lost, kept, empty = writer.write(iter(rows)), writer.write(iter(rows)), writer.write(iter([]))
    assert lost.folder != kept.folder and all("/_attempts-" in f"/{x}" for x in files_below(tmp_path / "out"))
    writer.commit([kept, empty, None])
    assert [x.split("/", 1)[1] for x in files_below(tmp_path / "out")] == ["00000.zip", "00001.zip", "00002.zip"]
