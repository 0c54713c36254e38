"""Structure of PDFs, byte by byte."""

import pytest

from sievemill.functions.pdf import structure
from sievemill.sources.tables import read_structures


def pdf(objects=3, before=b"", shift=0, eol=b" \n", version=b"1.7", update=False):
    out, offsets = bytearray(before + b"%PDF-" + version + b"\n%\xe2\xe3\xcf\xd3\n"), []
    for k in range(1, objects + 1):
        offsets.append(len(out) - len(before))
        out += b"%d 0 obj\n<< /K %d >>\nendobj\n" % (k, k)
    at = len(out) - len(before)
    out += b"xref\n0 %d\n0000000000 65535 f%s" % (objects + 1, eol) + b"".join(b"%010d 00000 n%s" % (o + shift, eol) for o in offsets)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (objects + 1, at)
    if update:
        new = len(out) - len(before)
        out += b"2 1 obj\n<< /New true >>\nendobj\n"
        table = len(out) - len(before)
        out += b"xref\n2 1\n%010d 00001 n%s" % (new, eol) + b"trailer\n<< /Size 4 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, table)
    return bytes(out)


@pytest.mark.parametrize(
    "content, want",
    [
        (pdf(), ("sound", "1.7", 3, 0)),
        (pdf(eol=b"\r\n"), ("sound", "1.7", 3, 0)),
        (pdf(before=b"junk\n"), ("sound", "1.7", 3, 0)),
        (pdf(update=True), ("sound", "1.7", 4, 0)),
        (pdf(400), ("sound", "1.7", 400, 0)),
        (pdf(shift=3), ("damaged", "1.7", 3, 3)),
        (pdf(objects=0), ("damaged", "1.7", 0, 0)),
        (pdf()[:-30], ("truncated", "1.7", 0, 0)),
        (pdf()[:20], ("truncated", "1.7", 0, 0)),
        (pdf() + b" " * 2000, ("truncated", "1.7", 0, 0)),
        (pdf().replace(b"startxref\n", b"startxref\n9"), ("truncated", "1.7", 0, 0)),
        (pdf().replace(b"/Root", b"/Boot"), ("damaged", "1.7", 3, 0)),
        (pdf().replace(b"0000000000 65535 f", b"00000000 65535 f  "), ("damaged", "1.7", 0, 1)),
        (b"%PDF-1.5\n5 0 obj\n<< /Type /XRef /Root 1 0 R /Size 6 >>\nstream\n\x00\xff\nendstream\nendobj\nstartxref\n9\n%%EOF", ("sound", "1.5", 1, 0)),
        (b"%PDF-1.5\n5 0 obj\n<< /Type /Other >>\nstream\nendstream\nstartxref\n9\n%%EOF", ("damaged", "1.5", 0, 1)),
        (b"  <!DOCTYPE HTML><html>", ("html", None, 0, 0)),
        (b"\xef\xbb\xbf<html>", ("html", None, 0, 0)),
        (b"plain text", ("not_pdf", None, 0, 0)),
        (b"", ("empty", None, 0, 0)),
        (None, ("empty", None, 0, 0)),
    ],
)
def test_structure(content, want):
    assert tuple(structure(content)) == want


def test_loops_end():
    looped = pdf(update=True).replace(b"/Prev", b"/Prev 99999 /Prev")
    assert structure(looped).state == "truncated"
    own = pdf()
    at = own.index(b"xref\n0")
    assert structure(own.replace(b"/Root 1 0 R", b"/Root 1 0 R /Prev %d" % at)).state == "sound"


def test_files(spark, tmp_path):
    made = {"a b.pdf": pdf(), "ü+%.pdf": pdf()[:-9], "x/empty.pdf": b"", "x/page.pdf": b"<html>", "empty 2.pdf": b""}
    (tmp_path / "x").mkdir()
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.split(f"{tmp_path.name}/")[1]: r.state for r in read_structures(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if "ü" not in k} == {"a b.pdf": "sound", "x/empty.pdf": "empty", "x/page.pdf": "html", "empty 2.pdf": "empty"}
    assert len(got) == 5 and sorted(got.values()).count("truncated") == 1


def test_small_files_are_written_by_many_tasks(spark, tmp_path):
    """Rows of one split: each its own file, and more than one task made them."""
    from pyspark.sql import functions as F

    from sievemill.sources.tables import write_files

    rows = spark.range(40).coalesce(1).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id")).alias("value"))
    write_files(rows, "k", f"{tmp_path}/f")
    files = [p for p in (tmp_path / "f").rglob("part-*") if p.suffix == ".txt"]
    assert {(p.parent.name, p.read_text()) for p in files} == {(f"k={k}", f"text {k}\n") for k in range(40)} and len(files) == 40
    assert len({p.name.split("-")[1] for p in files}) > 1
