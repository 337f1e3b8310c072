"""The splittable reader against a plain splitter, for byte ranges of any size."""

import random
import re

import pytest

from corpusloom.sources import annotations, corpus, lines


def plain(raw, terminators):
    """(content or raw bytes, ending, start, end) of each line, by one regular expression over the bytes."""
    body = rb"([^\r\n]*)(\r\n|\n|\r)|([^\r\n]+)$" if terminators == lines.ANY else rb"([^\n]*?)(\r?\n)|([^\n]+?)(\r?)$"
    out = []
    for m in re.finditer(body, raw):
        if m.group(0):
            x, end = (m.group(1), m.group(2)) if m.group(2) is not None else (m.group(3), m.group(4) if terminators == lines.LF_ONLY else b"")
            out.append((x, end.decode(), m.start(), m.end()))
    return out


def told(r):
    return (r["content"].encode() if r["raw"] is None else bytes(r["raw"]), r["ending"], r["byte_start"], r["byte_end"])


@pytest.mark.parametrize("terminators", [lines.ANY, lines.LF_ONLY])
def test_ranges_of_any_size_give_the_same_rows(spark, tmp_path, terminators):
    rng = random.Random(5)
    parts = [b"\r", b"\n", b"\r\n", b"\r\r\n", b"a", b"1|2|x", "é 😀".encode(), b"\xff", b"\xc3", b"long " * 30, b" "]
    raws = {f"{i}.txt": b"".join(rng.choice(parts) for _ in range(n)) for i, n in enumerate((0, 1, 7, 300, 900))}
    raws |= {"bom.txt": b"\xef\xbb\xbf1|1|a\r2\r\n3", "end.txt": b"x\r", "lf.txt": b"\n\n", "both.txt": b"\xef\xbb\xbfx\ny\n", "cut.txt": b"a" * 63 + b"\r\n" + b"b" * 63 + b"\r\n"}
    for name, raw in raws.items():
        (tmp_path / name).write_bytes(raw)
    key = "spark.sql.files.maxPartitionBytes"
    try:
        for size in (1 << 27, 4096, 64, 7):
            spark.conf.set(key, str(size))
            read = lines.read_lines(spark, str(tmp_path), terminators)
            if size == 64:
                assert read.rdd.getNumPartitions() >= 1 and spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20
            rows = read.orderBy("path", "line_no").collect()
            for name, raw in raws.items():
                mine = [r for r in rows if r["path"].endswith("/" + name)]
                assert [told(r) for r in mine] == plain(raw, terminators), (name, size)
                assert [r["line_no"] for r in mine] == list(range(1, len(mine) + 1))
            assert all((r["content"] is None) == (r["raw"] is not None) for r in rows)
    finally:
        spark.conf.unset(key)


def test_bytes_that_are_no_text_are_malformed_records(spark, tmp_path):
    (tmp_path / "c.txt").write_bytes(b"1|1|good\n1|2|\xff\xfe\nx|y|z\n0|1|z\n")
    rows = corpus.read_corpus(spark, str(tmp_path / "c.txt")).orderBy("line_no").collect()
    assert [r["record_type"] for r in rows] == ["unit_record", "malformed", "malformed", "malformed"]
    (tmp_path / "a.tsv").write_bytes(b"(1:1:1:1)\t\xff\tN\tPOS:N\n(1:1:1:1)\tx\tN\tPOS:N\n")
    assert [r["parse_status"] for r in annotations.read_v04(spark, str(tmp_path / "a.tsv")).orderBy("line_no").collect()] == ["malformed", "parsed"]
    assert [r["parse_status"] for r in annotations.read_synthetic(spark, str(tmp_path / "a.tsv")).orderBy("line_no").collect()] == ["malformed", "malformed"]


def test_lines_are_not_shuffled(spark, tmp_path, capsys):
    """Only sums of ranges are: lines are numbered where they are read."""
    (tmp_path / "c.txt").write_bytes(b"1|1|a\r2|1|b\r\n\n")
    lines.read_lines(spark, str(tmp_path)).select("line_no", "content").explain("formatted")
    text = capsys.readouterr().out
    assert "SortMergeJoin" not in text and text.count("MapInArrow") >= 1
    assert not any("value" in x for x in __import__("re").findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", text))
