"""Sinks, connector, scheduling and media on hand-made values and against plain restatements."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quirelake.operators import connector, media, results, scheduling


def test_combined_list_is_one_json_text(spark, tmp_path):
    rows = [(k, json.dumps({"name": f"d{k}", "list": [1, [2, "ü\n]"]], "empty": {}})) for k in (7, 3, 11)]
    results.write_combined(spark.createDataFrame(rows, "doc_idx long, record string").repartition(3), str(tmp_path / "all"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "all").glob("part-*")))
    assert [r["name"] for r in json.loads(text)] == ["d3", "d7", "d11"]
    back = results.read_combined(spark, str(tmp_path / "all"), "name string, empty string").orderBy("position").collect()
    assert [(r.position, r.name) for r in back] == [(0, "d3"), (1, "d7"), (2, "d11")]
    results.write_combined(spark.createDataFrame([], "doc_idx long, record string"), str(tmp_path / "none"))
    assert results.read_combined(spark, str(tmp_path / "none"), "name string").count() == 0
    assert results.read_combined(spark, str(tmp_path / "missing"), "name string").count() == 0


def test_repeated_and_missing_places_make_one_json_text(spark, tmp_path):
    rows = [(k, json.dumps({"name": n})) for k, n in ((4, "a"), (4, "b"), (4, "b"), (None, "z"), (9, "c"), (None, "y"))]
    results.write_combined(spark.createDataFrame([*rows, (1, None)], "doc_idx long, record string").repartition(3), str(tmp_path / "all"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "all").glob("part-*")))
    names = [r["name"] for r in json.loads(text)]
    assert sorted(names[:3]) == ["a", "b", "b"] and names[3] == "c" and sorted(names[4:]) == ["y", "z"]
    back = results.read_combined(spark, str(tmp_path / "all"), "name string").orderBy("position").collect()
    assert [r.name for r in back] == names


def test_record_files(spark, tmp_path):
    names = ["b", "0012", "7.50", "12", "2024-01-01", "null", "", "ü/x", "0012"]
    rows = spark.createDataFrame([(n, f'{{"x":[1,2],"t":"é","k":{k}}}') for k, n in enumerate(names)], "name string, record string")
    results.write_records(rows, str(tmp_path / "r"))
    back = results.read_records(spark, str(tmp_path / "r")).collect()
    assert [r.name for r in back] == sorted(names, key=str.encode) and {json.loads(r.record)["k"] for r in back} == set(range(9))
    assert back[-3].record == '{\n "x": [\n  1,\n  2\n ],\n "t": "é",\n "k": 0\n}'
    assert len(list((tmp_path / "r").glob("*.parquet"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [json.loads(r.record)["k"] for r in results.read_records(spark, str(tmp_path / "r"), ["0012"]).collect()] == [1, 8]
    assert results.read_records(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_bytes(b"no table")
    with pytest.raises(Exception, match="x.parquet"):  # an error of reading is no empty result
        results.read_records(spark, str(tmp_path / "broken")).count()


def test_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f"line {k}\n" if k % 5 else "\n" for k in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert spark.read.text(str(tmp_path / "x.jsonl")).rdd.getNumPartitions() > 1
        rows = results.read_lines(spark, str(tmp_path / "x.jsonl")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 4000 and all(r.value == (f"line {r.line}" if r.line % 5 else "") for r in rows)


def test_positional_pairs_need_equal_lengths(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"]), ([], [])], "l array<int>, r array<string>")
    assert [[tuple(p) for p in r.z] for r in df.select(results.zipped(F.col("l"), F.col("r")).alias("z")).collect()] == [[(1, "a"), (2, "b")], []]
    with pytest.raises(Exception, match="2 asked for, got 1"):
        spark.createDataFrame([([1, 2], ["a"])], "l array<int>, r array<string>").select(results.zipped(F.col("l"), F.col("r"))).collect()


def test_endpoint_tries_again_and_gives_up():
    said, calls = iter([OSError("reset"), (503, b""), (200, b'{"choices":[{"message":{"content":"ok"}}]}')]), []

    def transport(url, body, timeout):
        calls.append((url, json.loads(body)))
        got = next(said)
        if isinstance(got, Exception):
            raise got
        return got

    there = connector.Endpoint("http://m/v1", "any", max_tokens=5, pause=0.0, transport=transport)
    assert there.ask("q", "data:image/png;base64,AA==") == ("ok", 3, None)
    assert calls[0][0] == "http://m/v1/chat/completions" and calls[0][1]["max_tokens"] == 5 and calls[0][1]["temperature"] == 0 and len(calls[0][1]["messages"][0]["content"]) == 2
    assert connector.Endpoint("x", "m", retries=1, pause=0.0, transport=lambda *a: (429, b"")).ask("q") == (None, 2, "HTTP 429")
    assert connector.Endpoint("x", "m", pause=0.0, transport=lambda *a: (401, b"")).ask("q") == (None, 1, "HTTP 401")


def test_failures_stay_with_their_rows_or_end_the_job(spark):
    def transport(url, body, timeout):
        return (200, b'{"choices":[{"message":{"content":"y"}}]}') if b"good" in body else (400, b"")

    rows = spark.createDataFrame([("good", 1), ("bad", 2)], "question string, k int")
    there = connector.Endpoint("x", "m", transport=transport)
    assert {(r.k, r.raw, r.error) for r in connector.answered(rows, there, 2).collect()} == {(1, "y", None), (2, None, "HTTP 400")}
    with pytest.raises(Exception, match="HTTP 400"):
        connector.answered(rows, there, 2, fail_fast=True).collect()


def test_admission_matches_a_plain_restatement(spark):
    rnd = random.Random(6)
    rows = [(q, k, float(b := rnd.randint(0, 200)), float(b + rnd.randint(1, 60))) for q in ("a", "b") for k in range(80)]
    want = {}
    for q in ("a", "b"):
        ends = []
        for _, k, b, e in sorted((r for r in rows if r[0] == q), key=lambda r: (r[2], r[1])):
            ends = [x for x in ends if x > b]
            want[q, k] = len(ends) < 3
            ends += [e] * want[q, k]
    got = {(r.queue, r.id): r.accepted for r in scheduling.admitted(spark.createDataFrame(rows, "queue string, id int, begins double, ends double"), "queue", 3).collect()}
    assert got == want and not all(want.values())


@pytest.mark.parametrize("span", [40, 100_000])
def test_admission_over_many_ranges(spark, monkeypatch, span):
    """Queues cut into ranges, with ties, nulls, NaN and ends that stay open over several ranges."""
    monkeypatch.setattr(scheduling, "RANGE", 32)
    rnd, nan = random.Random(8), float("nan")
    rows = [(q, k, rnd.choice([None, nan, *[float(rnd.randint(0, span)) for _ in range(40)]]), None) for q in ("a", "b", None, *"cdefgh") for k in range(200 if q in ("a", None) else 9)]
    rows = [(q, k, b, rnd.choice([None, nan if k % 50 == 9 else None, *[(b or 0.0) + rnd.choice([0, 1, span / 9, span / 60]) for _ in range(9)]])) for q, k, b, _ in rows]
    later = lambda x, b: None not in (x, b) and (x > b or (x != x and b == b))
    up = lambda v: (v is not None, v != v, 0 if v is None or v != v else v)
    want = {}
    for q in {r[0] for r in rows}:
        ends = []
        for _, k, b, e in sorted((r for r in rows if r[0] == q), key=lambda r: (up(r[2]), r[1])):
            ends = [x for x in ends if later(x, b)]
            want[q, k] = len(ends) < 3
            ends += [e] * want[q, k]
    frame = spark.createDataFrame(rows, "queue string, id int, begins double, ends double").repartition(3)
    found = scheduling.admitted(frame, "queue", 3)
    assert found.columns == ["queue", "id", "begins", "ends", "accepted"] and {(r.queue, r.id): r.accepted for r in found.collect()} == want and not all(want.values())
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert scheduling.admitted(frame.limit(0), "queue", 3).count() == 0


def test_micro_batches_match_a_plain_restatement(spark):
    rnd = random.Random(7)
    rows = [(q, k, rnd.random() * 30) for q in (1, 2) for k in range(60)]
    want = {}
    for q in (1, 2):
        batch, n, opened = -1, 0, 0.0
        for _, k, at in sorted((r for r in rows if r[0] == q), key=lambda r: (r[2], r[1])):
            if batch < 0 or n == 4 or at >= opened + 1.0:
                batch, n, opened = batch + 1, 0, at
            n += 1
            want[q, k] = batch
    got = {(r.queue, r.id): r.batch for r in scheduling.micro_batches(spark.createDataFrame(rows, "queue int, id int, at double"), "queue", 4, 1.0).collect()}
    assert got == want


def test_jpeg_sizes_and_orientation():
    def jpeg(turned, order):
        exif = b"Exif\0\0" + (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, turned, 0, 0)
        return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, 30, 40, 1) + b"\1\x11\0"

    assert media.image_header(jpeg(6, ">")) == ("jpeg", 40, 30, 6) and media.image_header(jpeg(3, "<")) == ("jpeg", 40, 30, 3)
    assert media.image_header(jpeg(6, ">")[:30]) is None and media.image_header(b"") is None and media.image_header(b"\x89PNG\r\n\x1a\n\0") is None


def test_pdf_pages_are_counted_in_streams_as_well():
    packed = zlib.compress(b"6 0 7 18 8 49 << /Type /Page >> << /Type /Page/Parent 1 0 R >> << /Type /Pages >>")
    data = b"%PDF-1.5\n1 0 obj << /Type /Page >> endobj 5 0 obj << /Type /ObjStm /N 3 /First 16 >>\nstream\r\n" + packed + b"\nendstream"
    assert media.page_count(data) == 3
    assert media.page_count(b"x" * 1020 + b"%PDF-1.5") is None and media.page_count(None) is None and media.page_count(b"junk %PDF-1.4 /Type/Page") == 1


def pdf(*objects, root=1):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects) + (b"trailer << /Root %d 0 R >>\n" % root if root else b"")


def test_pages_of_updated_packed_and_broken_files():
    page, tree = b"<< /Type /Page /Parent 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"
    first = pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, tree), (3, page))
    assert media.page_count(first) == 1
    assert media.page_count(first + pdf((3, page + b" % again"))[9:]) == 1  # an update of the page
    assert media.page_count(first + pdf((2, tree.replace(b"Count 1", b"Count 2")), (4, page))[9:]) == 2  # one more page
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, tree.replace(b"Count 1", b"Count 7")), (3, page)]
    bodies, at, head = b"", [], b""
    for number, body in inner:
        head += b"%d %d " % (number, len(bodies))
        bodies += body + b" "
    stream = b"<< /Type /ObjStm /N 3 /First %d /Length 1 >>\nstream\n" % len(head) + zlib.compress(head + bodies) + b"\nendstream"
    assert media.page_count(pdf((9, stream))) == 7
    assert media.page_count(pdf((9, stream.replace(b"/First", b"/Fist")))) == 0  # nothing to follow, nothing to count
    assert media.page_count(pdf((3, page), (4, page), (3, page), root=None)) == 2  # each number once
    assert media.page_count(b"%PDF-1.4" + b" 1 0 obj" * 200_000) == 0


def test_webp_and_tiff_headers():
    riff = lambda kind, body: b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0" + body
    lossy = riff(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 640 | 1 << 14, 480))
    lossless = riff(b"VP8L", b"\x2f" + struct.pack("<I", 799 | 599 << 14) + b"\0" * 5)
    canvas = riff(b"VP8X", b"\0\0\0\0" + (69_999).to_bytes(3, "little") + (11).to_bytes(3, "little"))
    assert [media.image_header(x) for x in (lossy, lossless, canvas)] == [("webp", 640, 480, 1), ("webp", 800, 600, 1), ("webp", 70_000, 12, 1)]
    for order, mark in (("<", b"II*\0"), (">", b"MM\0*")):
        entries = [struct.pack(order + "HHIHH", 256, 3, 1, 321, 0), struct.pack(order + "HHII", 257, 4, 1, 70_001), struct.pack(order + "HHIHH", 274, 3, 1, 6, 0)]
        data = mark + struct.pack(order + "I", 10) + b"xx" + struct.pack(order + "H", 3) + b"".join(entries)
        assert media.image_header(data) == ("tiff", 321, 70_001, 1)
        assert media.image_header(data[:20]) is None and media.image_header(data.replace(entries[1], entries[0])) is None
    assert media.image_header(lossy[:25]) is None and media.image_header(riff(b"XXXX", b"")) is None


def test_sizes_that_cannot_be_loaded_become_the_dummy(spark):
    df = spark.createDataFrame([(None, 3), (0, 5), (2010, 10), (2000, 10), (10, 10)], "w int, h int")
    got = [tuple(r.s) for r in df.select(media.loaded_size(F.col("w"), F.col("h"), doubled=True).alias("s")).collect()]
    assert got == [(32, 32), (32, 32), (32, 32), (4000, 20), (20, 20)]


def test_overlay_is_a_pdf_with_its_pages():
    data = media.overlay_pdf([(600, 800, [(1, 2, 30, 40, "Text (a\\b) é")]), (300, 400, [])])
    assert media.page_count(data) == 2 and data.endswith(b"%%EOF\n") and b"(0: Text \\(a\\\\b\\) \xe9) Tj" in data
    start = int(data.split(b"startxref\n")[1].split()[0])
    assert data[start : start + 4] == b"xref"
    for k, line in enumerate(data[start:].split(b"\n")[3:10], 1):
        at = int(line.split()[0])
        assert data[at:].startswith(b"%d 0 obj" % k)


def test_one_backend_is_held_for_equal_settings():
    made, closed = [], []

    class Backend:
        def __init__(self, settings):
            made.append(settings)

        def close(self):
            closed.append(self)

    held = connector.Held()
    one = held.get({"a": 1, "b": 2}, Backend)
    assert held.get({"b": 2, "a": 1}, Backend) is one and len(made) == 1
    two = held.get({"a": 3}, Backend)
    assert two is not one and closed == [one]


def test_only_listed_texts_are_read(spark, tmp_path):
    from quirelake.sources import files

    for name in ("a.md", "sub/b.md", "c.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"# {name} é")
    manifest = spark.createDataFrame([("sub/b.md",), ("a.md",), ("gone.md",)], "path string")
    assert [(r.path, r.value) for r in files.read_listed(spark, str(tmp_path), manifest).collect()] == [("a.md", "# a.md é"), ("sub/b.md", "# sub/b.md é")]
