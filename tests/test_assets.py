"""References, envelopes, predicates and archives on hand-made values."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelake.functions import assets
from quirelake.operators import archives


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("markdown", "asset", "found"),
    [
        ("texts/one.md", "../pics/p1.jpg", "pics/p1.jpg"), ("texts/one.md", "./near.png", "texts/near.png"), ("one.md", "ftp://other.example/p1.jpg", None),
        ("one.md", "/pics/p1.jpg", None), ("one.md", "../pics/p1.jpg", None), ("one.md", "pics/p2.jpg", None), ("one.md", "", None), ("a/b/c.md", "../../pics//p1.jpg?x", "pics/p1.jpg"),
    ],
)
def test_resolve_asset(spark, markdown, asset, found):
    files = F.array(F.lit("pics/p1.jpg"), F.lit("texts/near.png"))
    assert one(spark, assets.resolve_asset(F.col("m"), F.col("a"), files), m=markdown, a=asset) == found


def test_inlined_images(spark):
    files = F.create_map(F.lit("a.jpg"), assets.data_uri(F.lit("x").cast("binary"), F.lit("a.jpg")))
    got = one(spark, assets.inlined(F.col("m"), files), m="t ![p](a.jpg) ![q](b.png) ![r](https://z/a.jpg)\nend")
    assert got == "t ![p](data:image/jpeg;base64,eA==) ![q](b.png) ![r](https://z/a.jpg)\nend"
    assert one(spark, assets.image_references(F.col("m")), m="![](x) ![a](y z)") == ["x", "y z"]


@pytest.mark.parametrize(
    ("status", "body", "code"),
    [
        (200, '{"internal_code":"SUCCESS","data":{"a":1}}', None), (200, '{"internal_code":"SUCCESS","data":[1]}', "SUCCESS"), (200, "nope", "BACKEND_UNAVAILABLE"),
        (404, '{"internal_code":"GONE","message":"m"}', "GONE"), (503, '{"internal_code":"GONE"}', "BACKEND_UNAVAILABLE"),
    ],
)
def test_upstream_errors(spark, status, body, code):
    got = one(spark, assets.upstream_error(F.col("s"), F.col("b")), s=status, b=body)
    assert (got and got["code"]) == code


def test_predicates(spark):
    assert one(spark, assets.is_request_id(F.col("s")), s="0a-f") and not one(spark, assets.is_request_id(F.col("s")), s="")
    assert one(spark, assets.is_session_token(F.col("s")), s="a" * 32) and not one(spark, assets.is_session_token(F.col("s")), s="a" * 31)
    assert one(spark, assets.is_retryable(F.col("s")), s=503) and not one(spark, assets.is_retryable(F.col("s")), s=404)


def zipped(*members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return held.getvalue()


def lying(name, content, claimed):
    """An archive whose listing claims fewer bytes than its member has."""
    data = bytearray(zipped((name, content)))
    for mark, at in ((b"PK\x01\x02", 24), (b"PK\x03\x04", 22)):
        k = data.index(mark)
        data[k + at : k + at + 4] = claimed.to_bytes(4, "little")
    return bytes(data)


def test_archive_rules(spark):
    link = zipfile.ZipInfo("notes/way.txt")
    link.external_attr = 0o120777 << 16
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr(link, "elsewhere")
    rows = [
        ("fine", zipped(("notes/x.txt", "abcde"), ("notes/raw.bin", "x" * 99))), ("up", zipped(("../out.txt", "x"))), ("rooted", zipped(("/root/out.txt", "x"))), ("drive", zipped(("D:/x.txt", "x"))),
        ("inside", zipped(("a/../../b.txt", "x"))), ("large", zipped(("notes/x.txt", "1234567"), ("notes/y.txt", "12345678"))), ("many", zipped(*((f"{k}.txt", "") for k in range(6)))), ("link", held.getvalue()),
        ("broken", b"no zip"), ("lying", lying("notes/x.txt", "y" * 40, 3)), ("null", None),
    ]
    got = archives.unpacked(spark.createDataFrame(rows, "archive string, zip binary"), 5, 14, (".txt",)).collect()
    assert {(r.archive, r.member, r.error) for r in got if r.archive != "lying"} == {
        ("fine", "notes/x.txt", None), ("up", None, "an unsafe path"), ("rooted", None, "an unsafe path"), ("drive", None, "an unsafe path"), ("inside", None, "an unsafe path"),
        ("large", None, "over the extraction limit"), ("many", None, "too many files"), ("link", None, "an unsafe path"), ("broken", None, "not a valid archive"), ("null", None, "not a valid archive"),
    }
    (lie,) = [r for r in got if r.archive == "lying"]
    assert lie.error is not None and lie.content is None
