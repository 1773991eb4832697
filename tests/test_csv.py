import pytest

from reqsieve.sources import request_csv
from reqsieve.schemas import CSV_COLUMNS

HEADER = ",".join(CSV_COLUMNS)
KEPT = {
    "x,US,30,F,Acme,50,320,wifi,1,0,7,0.5,1.0": {"brand": "Acme", "withBundleId": True, "withGeoInfo": False},
    "x,,30,,,50,320,,,0,7,0.5,0": {"country": "", "gender": "", "connectionType": "", "withBundleId": True, "isWinning": 0.0},
    "x,US,30,F,Acme,50,320,wifi,1,0,7,0.5,1.0,extra": {"isWinning": 1.0},
    'x,US,30,F,"Acme,50,320,wifi,1,0,7,0.5,1.0': {"brand": '"Acme'},
    "x,US,30,F,Ac\\me,50,320,wifi,1,0,7,0.5,1.0": {"brand": "Ac\\me"},
    "x,US,+30,F,Acme,50,320,wifi,1,0,-7,0.5,1.0": {"age": 30, "publisherId": -7},
    "x,US,30, F ,Acme,50,320,wifi,1,0,7, .5d ,1e0": {"gender": " F ", "rtbFloorSent": 0.5},
    "x,US,30,F,Acme,50,320,wifi,1,0,7,0x1p3,5.": {"rtbFloorSent": 8.0, "isWinning": 5.0},
    "x,US,30,F,Acme,50,320,wifi,1,0,7,-Infinity,1": {"rtbFloorSent": float("-inf")},
}
DROPPED = {
    "x,US,30.7,F,Acme,50,320,wifi,1,0,7,0.5,1.0": "age",
    "x,US, 30,F,Acme,50,320,wifi,1,0,7,0.5,1.0": "age",
    "x,US,2147483648,F,Acme,50,320,wifi,1,0,7,0.5,1.0": "age",
    "x,US,30,F,Acme,50,320,wifi,1,0,7,0.5,": "isWinning",
    "x,US,30,F,Acme,50,320,wifi,1,0,7,0.5,yes": "isWinning",
    "x,US,30,F,Acme,50,320,wifi,1,0,7,inf,1": "rtbFloorSent",
    "x,US,30,F,Acme,,320,wifi,1,0,7,0.5,1": "height",
    "x,US,30,F,Acme,50,3 0,wifi,1,0,7,0.5,1": "width",
    "x,US,30,F,Acme,50,320,wifi,1,0,,0.5,1": "publisherId",
    "x,US,30,F": "publisherId",
}


def write(path, *files):
    for i, lines in enumerate(files):
        (path / f"part{i}.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    return request_csv


@pytest.mark.parametrize("line", KEPT)
def test_kept(spark, tmp_path, line):
    lines = write(tmp_path, [line]).read_lines(spark, str(tmp_path))
    row = request_csv.parse_lines(lines).first()
    assert row is not None
    assert {k: row[k] for k in KEPT[line]} == KEPT[line]
    assert request_csv.rejected_lines(lines).count() == 0


def test_dropped_with_a_reason(spark, tmp_path):
    lines = write(tmp_path, DROPPED).read_lines(spark, str(tmp_path))
    assert request_csv.parse_lines(lines).count() == 0
    assert [r.reject_reason for r in request_csv.rejected_lines(lines).collect()] == list(DROPPED.values())


def test_one_header_per_file_of_a_glob(spark, tmp_path):
    write(tmp_path, list(KEPT), [*DROPPED, *KEPT])
    lines = request_csv.read_lines(spark, f"{tmp_path}/*.csv")
    kept, rejected = request_csv.parse_lines(lines).count(), request_csv.rejected_lines(lines).count()
    assert (kept, rejected) == (2 * len(KEPT), len(DROPPED))
    assert kept + rejected == lines.count()
