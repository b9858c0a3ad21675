"""Column functions and table markup against hand-made values and plain restatements."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.functions import geometry, text
from quirelake.operators import layout, tables


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_strip_takes_unicode_spaces(spark):
    assert one(spark, text.strip(F.col("s")), s="\u00a0\u2003 a b\x1c\n") == "a b"


def plain_repeat(t):
    return any(t.endswith(t[-n:] * (int(4 * (1 + 3 / n)) + 1)) for n in range(1, 251) if len(t) >= n)


def test_repeated_endings_match_a_plain_restatement(spark):
    rnd = random.Random(3)
    some = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) + "xyz"[: rnd.randint(0, 3)] * rnd.randint(0, 18) for _ in range(300)] + ["", "a" * 17, "a" * 16, "ab" * 11, "ab" * 10]
    rows = spark.createDataFrame([(s,) for s in some], "s string").select("s", text.has_repeated_ending(F.col("s")).alias("x"), text.is_repetitive(F.col("s")).alias("y")).collect()
    for r in rows:
        assert r.x == plain_repeat(r.s), r.s
        assert r.y == (plain_repeat(r.s) or (len(r.s) > 50 and plain_repeat(r.s[:-50]))), r.s


@pytest.mark.parametrize(
    ("raw", "body", "number"),
    [
        ("$x$", "x", None),
        ("$a$ b $c$", "a$ b $c", None),
        (r"a \quad (12)", "a", "12"),
        (r"a \tag{3}", "a", None),
        (r"\begin{eq} y \end{eq} \eqno (7)", "\\begin{eq}\ny\n\\end{eq}", "7"),
        (r"\begin{a}x", "\\begin{a}\nx\n\\end{a}", None),
        (r"\begin{a}x \tag{2}\end{a} \quad (1)", "\\begin{a}\nx\n\\end{a}", None),
        (r"p\quad \quad \quad \quad \quad q", r"p\quad q", None),
    ],
)
def test_formulas(spark, raw, body, number):
    got = one(spark, text.clean_formula(F.col("s")), s=raw)
    assert (got["body"], got["number"]) == (body, number)


def test_block_formats(spark):
    def made(label, raw, prompted=True):
        return one(spark, text.format_block(F.col("l"), F.col("r"), F.lit(prompted), F.lit("<t>"), F.lit("../images/d_sub0.jpg")), l=label, r=raw)

    assert made("Title", " a\n\nb ") == "# a\n# \n# b"
    assert made("Section-header", "a") == "## a"
    assert made("Formula", r"$x \quad (1)$") == "$$\nx\n$$\n1"
    assert made("Table", "whatever") == "<t>"
    assert made("Picture", "") == "![image](../images/d_sub0.jpg)"
    assert made("Footnote", "gone", prompted=False) == ""


def test_artifact_names(spark):
    assert one(spark, text.artifact_name(F.col("s"), F.lit(".zip")), s="a.b") == "a.b.zip"
    long = one(spark, text.artifact_name(F.col("s"), F.lit("_pages.tar")), s="界" * 137)
    assert len(long.encode()) <= 255 and long.endswith("_pages.tar") and long.startswith("界界")


@pytest.mark.parametrize(
    ("name", "safe"),
    [("a b?.PDF", "a_b.pdf"), ("/x/y\\z.png", "z.png"), ("", "upload.bin"), ("...", "upload.bin"), ("n" * 200 + ".jpg", "n" * 128 + ".jpg"), ("noext", "noext.bin"), (".hidden", "hidden.bin")],
)
def test_upload_names(spark, name, safe):
    assert one(spark, text.upload_name(F.col("s")), s=name) == safe


@pytest.mark.parametrize(
    ("raw", "url"), [("host:8000/", "http://host:8000"), ("https://localhost:1/v1//", "http://localhost:1/v1"), ("https://far.example/", "https://far.example"), ("ftp://x", None), (" ", "")]
)
def test_server_urls(spark, raw, url):
    assert one(spark, text.server_url(F.col("s")), s=raw) == url


def test_small_text_functions(spark):
    assert one(spark, text.image_repository(F.col("s")), s="reg:5000/a/b:1@sha256:ff") == "reg:5000/a/b"
    assert one(spark, text.positive_int(F.col("s")), s="0") == 1 and one(spark, text.positive_int(F.col("s")), s=" 3 ") == 3
    assert one(spark, text.script_ratio(F.col("s"), r"[\u0600-\u06FF]"), s="data:image/png;base64,aaaa ابab") == 0.5
    assert one(spark, text.path_segments_encoded(F.col("s")), s="a b/ü") == "a%20b/%C3%BC"
    assert one(spark, text.media_type(F.col("s")), s="x.TIFF") == "image"


def test_boxes_match_a_plain_restatement(spark):
    rnd = random.Random(5)
    rows = [(*(rnd.choice([rnd.uniform(-50, 1100), rnd.randint(0, 1000) / 2]) for _ in range(4)), rnd.choice([0, 1, 2, 999]), rnd.choice([1, 700])) for _ in range(400)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, w int, h int")
    got = df.select("*", geometry.box_to_pixels(*(F.col(c) for c in df.columns)).alias("b")).collect()
    for r in got:
        (x1, x2), (y1, y2) = sorted((r.x1 / 1000.0 * r.w, r.x2 / 1000.0 * r.w)), sorted((r.y1 / 1000.0 * r.h, r.y2 / 1000.0 * r.h))
        a, b = max(0, min(round(x1), max(r.w - 1, 0))), max(0, min(round(y1), max(r.h - 1, 0)))
        assert tuple(r.b) == (a, b, max(a + 1, min(round(x2), r.w)), max(b + 1, min(round(y2), r.h)))


@pytest.mark.parametrize(
    ("source", "otsl"),
    [
        ("<table><tr><td>Ort</td><td>Tag</td><td>Uhr</td></tr><tr><td>Ulm</td><td>Mo</td><td>9</td></tr></table>", "<fcel>Ort<fcel>Tag<fcel>Uhr<nl><fcel>Ulm<fcel>Mo<fcel>9<nl>"),
        ("<table><tr><th>\t</th><td></td></tr></table>", "<fcel>\t<ecel><nl>"),
        ("<table><tr><td>1 &lt; 2</td><td> R&amp;D\n</td></tr></table>", "<fcel>1 < 2<fcel> R&D\n<nl>"),
        ("<table><tr><td>p</td><td colspan='2'>wide</td></tr><tr><td>q</td><td>r</td><td>s</td></tr></table>", "<fcel>p<fcel>wide<lcel><nl><fcel>q<fcel>r<fcel>s<nl>"),
        ("<table><tr><td>k</td><td rowspan='2' colspan='2'>block</td></tr><tr><td>m</td></tr></table>", "<fcel>k<fcel>block<lcel><nl><fcel>m<ucel><xcel><nl>"),
        ("<table><tr><td>u</td><td rowspan='3'>v</td><td rowspan='2'>w</td></tr><tr><td>x</td></tr><tr><td>y</td><td>z</td></tr></table>", "<fcel>u<fcel>v<fcel>w<nl><fcel>x<ucel><ucel><nl><fcel>y<ucel><fcel>z<nl>"),
        ("<table><tr><td rowspan='-4' colspan='many'>odd</td></tr></table>", "<fcel>odd<nl>"),
        ("plain words", ""),
        ("<p>x</p><table><tr><td>left</td></tr></table><table><tr><td>right</td></tr></table>", "<fcel>left<nl>"),
    ],
)
def test_html_to_otsl(source, otsl):
    assert tables.from_html(source) == otsl


@pytest.mark.parametrize(
    ("otsl", "source"),
    [
        ("", "<table></table>"),
        ("<fcel>a<nl> <nl><fcel>b", "<table><tr><td>a</td></tr><tr></tr><tr><td>b</td></tr></table>"),
        ("<lcel><ucel>", "<table><tr><td></td><td></td></tr></table>"),
        ("<fcel>a\nb<fcel>c", "<table><tr><td>c</td></tr></table>"),
        ("<fcel>a<b>z", "<table><tr><td>a</td></tr></table>"),
        ("<fcel>a<fcel>t<nl><fcel>b<lcel><nl><fcel>c<ucel>", '<table><tr><td>a</td><td rowspan="2">t</td></tr><tr><td colspan="2">b</td></tr><tr><td>c</td></tr></table>'),
    ],
)
def test_otsl_to_html(otsl, source):
    assert tables.to_html(otsl) == source


def test_tolerant_items():
    def got(t):
        return [(i["x1"], i["label"], i["content"]) for i in layout.read_items(t)]

    assert got("[{'bbox': [1,2,3,'4'], 'label': 'Text', 'content': 'a]'}]") == [(1.0, "Text", "a]")]
    assert got("so: [{'bbox': (1,2,3,4), 'label': 5}, {'bbox': [1,2") == [(1.0, "5", "")]
    assert got("[{'bbox': [1,2,3], 'label': 'x'}]") == [] and got(None) == [] and got("[]") == []
    twice = "{'bbox':[1,2,3,4],'label':'T'}"
    assert len(got(f"[{twice}, {twice}]")) == 2 and len(got(f"{twice} and {twice}")) == 1


def test_dict_candidates_close_every_open_brace():
    assert list(layout.dict_candidates("x {a {b} {c")) == ["{a {b} {c}}", "{b}", "{c}"]
    assert list(layout.dict_candidates("}{}{")) == ["{}"]
    deep = "{" * 3000
    assert len(list(layout.dict_candidates(deep))) == layout.DEEPEST  # deeper ones are no literals


def quadratic_candidates(text):
    """Every brace with the rest it takes, restated without a limit."""
    found = [text[a:b] for a, b in layout.outermost(text, "{", "}")[0]]
    for at in (k for k, c in enumerate(text) if c == "{"):
        depth = 0
        for k in range(at, len(text)):
            depth += (text[k] == "{") - (text[k] == "}")
            if depth == 0:
                found.append(text[at : k + 1])
                break
        else:
            found.append(text[at:] + "}" * depth)
    return list(dict.fromkeys(found))


@given(st.text("{}a", max_size=24))
def test_dict_candidates_are_every_brace_with_its_rest(text):
    assert list(layout.dict_candidates(text)) == quadratic_candidates(text)


def test_a_hundred_thousand_braces_take_little_memory_and_time():
    import time
    import tracemalloc

    dicts = "{'bbox': [1, 2, 3, 4], 'label': 'Text', 'content': 'x'}"
    for text, items in (("{" * 100_000, 0), ("{" * 50_000 + "}" * 50_000, 0), (dicts + "{" * 100_000 + dicts.replace("'x'", "'y'"), 2), ("{'a': " * 100_000, 0)):
        tracemalloc.start()
        began = time.process_time()
        assert len(layout.read_items(text)) == items
        assert time.process_time() - began < 20 and tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a", "a"), (r"\quad\quad\quad\quad x", r"\quad\quad\quad\quad x"), (r"\quad\quad \quad\quad\quad  x", r"\quad x"), (r"a\quad\quad\quad\quad\quad", r"a\quad "), (r"\quad b\quad\quad\quad\quad\quad\quad c\quad d", r"\quad b\quad c\quad d"), (r"\qquad\quad", r"\qquad\quad"), ("", "")],
)
def test_filler_goes_in_runs_of_five(spark, raw, want):
    assert one(spark, text.without_filler(F.col("s"), r"\quad", 5), s=raw) == want


@pytest.mark.parametrize(
    ("raw", "body", "number"),
    [
        (r"u \eqno(12) ", "u", "12"), (r"u \qquad  (a.b)", "u", "a.b"), (r"u (3)", r"u (3)", None), (r"u \quad ((3)", r"u \quad ((3)", None), (r"u \quad ()", "u", None), (r"u \quad (3) v", r"u \quad (3) v", None),
        (r"u\tag{}", "u", None), (r"u \tag {3}", r"u \tag {3}", None), (r"u \tag{{3}", r"u \tag{{3}", None), (r")", ")", None), (r"}", "}", None), (r"\quad(9)", "", "9"),
        (r"\begin{}x", r"\begin{}x", None), (r"\begin{e", r"\begin{e", None), (r"\begin{e}x\end{e} \quad (4)", "\\begin{e}\nx\n\\end{e}", "4"), (r"\begin{e}x \quad (5)\end{e}", "\\begin{e}\nx\n\\end{e}", "5"),
    ],
)
def test_closing_numbers_and_environments(spark, raw, body, number):
    got = one(spark, text.clean_formula(F.col("s")), s=raw)
    assert (got["body"], got["number"]) == (body, number)


def test_marks_of_a_line():
    assert list(tables.marks("x<fcel>a <b<ecel><Lcel><lcel>t\n")) == [("fcel", "a <b"), ("ecel", "<Lcel>"), ("lcel", "t")]
    assert list(tables.marks("<fcel>a\nb<ecel>\n\n<ucel>")) == [("ucel", "")] and list(tables.marks("no marks")) == []
