"""Info tables in any state: nothing is lost."""

import json

import pytest

from sievemill.sources import tables
from sievemill.sources.tables import read_damaged_info


def read(spark, path):
    rows = read_damaged_info(spark, str(path)).selectExpr("*", "cast(rescued AS string) AS r").collect()
    return sorted([(r.case_name, r.study_id, r.author, r.year, r.doi, r.title, r.journal, json.loads(r.r) if r.r else None) for r in rows], key=str)


def test_every_value_is_somewhere(spark, tmp_path):
    (tmp_path / "a.csv").write_text('case_name,study_id,author,year,doi,title,journal\nc1,007,"Smith, J",2010,10.1/a,"Air, and\nhealth",Lancet\nc1,2,Doe,abcd,,T,J,extra,,more\nc1,3\n\n')
    (tmp_path / "b.csv").write_text("study_id,Author,note,case_name,note,,year\n9,Roe,hello,c2,again,bare,99999999999\n10,\"un\"\"quoted\"\"\",,c2,,,2001\n")
    (tmp_path / "c.csv").write_text("study_id\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text('author,study_id\n"never closed,1\nx,2\n')
    assert read(spark, tmp_path) == sorted(
        [
            ("c1", "007", "Smith, J", 2010, "10.1/a", "Air, and\nhealth", "Lancet", None),
            ("c1", "2", "Doe", None, None, "T", "J", {"year": "abcd", "column_8": "extra", "column_10": "more"}),
            ("c1", "3", None, None, None, None, None, None),
            ("c2", "9", "Roe", None, None, None, None, {"note": "hello", "note#5": "again", "column_6": "bare", "year": "99999999999"}),
            ("c2", "10", 'un"quoted"', 2001, None, None, None, None),
            (None, None, "never closed,1\nx,2\n", None, None, None, None, None),
        ],
        key=str,
    )


@pytest.mark.parametrize("n", [62, 64, 65, 90])
def test_very_wide_rows(spark, tmp_path, n):
    (tmp_path / "w.csv").write_text("study_id,year\n" + ",".join(str(k) for k in range(n)) + "\nlast,1\n")
    got = read(spark, tmp_path)
    assert [g[1] for g in got] == ["0", "last"] and got[0][3] == 1
    shown = got[0][7]
    assert {v for k, v in shown.items() if k != "line"} >= {str(k) for k in range(2, min(n, tables.MOST_COLUMNS))}
    if n > tables.MOST_COLUMNS:
        assert shown["line"].count(",") == n - 1
