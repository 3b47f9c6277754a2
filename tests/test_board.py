"""The page and its parts: every link leads to the rows that the index says, and no part is larger than stated."""

import html.parser
import json
import re

from lodestack.operators import report


class Links(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found += [v for k, v in attrs if tag == "a" and k == "href"]


def links_of(text):
    p = Links()
    p.feed(text)
    return p.found


def test_board_links_lead_to_all_rows(spark, tmp_path):
    rows = [(i if i % 50 else None, f"t{i % 7}", f'</script> "é"   {i}') for i in range(1200)] + [(77, "hot", "x")] * 700
    index = report.write_board(spark.createDataFrame(rows, "id long, tag string, x string"), f"file://{tmp_path}/b", "A <board>", "id", "tag", 100).collect()
    text = (tmp_path / "b/index.html").read_text()
    links = links_of(text)
    assert "A &lt;board&gt;" in text and text.count("</script>") == 1 and sorted(links) == sorted(z["file"] for z in index)
    assert all(not x.startswith("/") and ":" not in x for x in links)
    zones = {z["file"]: z for z in index}
    back = []
    for link in links:
        part = [json.loads(re.fullmatch(r"row\((.*)\);", line)[1]) for line in (tmp_path / "b" / link).read_text().split("\n") if line]
        keys = [r["id"] for r in part if r["id"] is not None]
        z = zones[link]
        assert len(part) == z["rows"] <= 100 and (min(keys, default=None), max(keys, default=None)) == (z["first"], z["last"])
        assert z["terms"] == sorted({r["tag"] for r in part})
        back += [(r["id"], r["tag"], r["x"]) for r in part]
    assert sorted(back, key=repr) == sorted(rows, key=repr)
    some = [z for z in index if z["first"] is not None and z["first"] <= 300 <= z["last"]]
    assert 0 < len(some) < len(index) / 2  # a key opens few parts
    known = json.loads(re.search(r"const board = (.*?), zones = ", text)[1])
    assert len(known["zones"]) == len(index) and known["key"] == "id" and known["term"] == "tag"


def test_board_without_terms_and_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, x string")
    assert report.write_board(df, f"file://{tmp_path}/one", "t", "id").count() == 1
    assert report.write_board(df.limit(0), f"file://{tmp_path}/none", "t", "id").count() == 0
    assert links_of((tmp_path / "none/index.html").read_text()) == []


def test_bundle_links_its_parts(spark, tmp_path):
    report.write_bundle(spark.createDataFrame([(i, "<x>") for i in range(10)], "id long, x string"), f"file://{tmp_path}/b", "T", "id", 3)
    found = [json.loads(line) for link in links_of((tmp_path / "b/index.html").read_text()) for line in (tmp_path / "b" / link).read_text().splitlines()]
    assert sorted(r["id"] for r in found) == list(range(10))


def test_history_is_folded_between_appends(spark, tmp_path):
    from lodestack.sources import tables

    path, ddl = f"file://{tmp_path}/h", "k long, snap_date string, version long, x string"
    files = lambda: len(list((tmp_path / "h").glob("snap_date=*/*.parquet")))
    rows = lambda: sorted((r["k"], str(r["snap_date"]), r["x"]) for r in tables.read_history(spark, path, "k").collect())
    for v in range(4):
        tables.append_history(spark.createDataFrame([(k, f"2024-01-0{d}", v, f"{k}{d}{v}") for k in range(20) for d in range(1, 1 + v)], ddl), path)
    before, many = rows(), files()
    assert tables.compact_history(spark, path, "k") == 3 and rows() == before and files() < many and files() == 3
    assert tables.compact_history(spark, path, "k") == 0
    tables.append_history(spark.createDataFrame([(3, "2024-01-01", 9, "new")], ddl), path)
    assert tables.compact_history(spark, path, "k") == 1 and files() == 3
    assert rows() == sorted([r for r in before if r[:2] != (3, "2024-01-01")] + [(3, "2024-01-01", "new")])
    assert spark.read.parquet(path).count() == len(before)  # older versions are gone
