"""Column functions over text: stripping, repeated endings, formulas, names, addresses."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels with the prompt that asks for their content.
_CONTENT = "Please output the text content from the image."
PROMPTS = {
    "Caption": _CONTENT,
    "List-item": _CONTENT,
    "Page-footer": _CONTENT,
    "Page-header": _CONTENT,
    "Section-header": _CONTENT,
    "Text": _CONTENT,
    "Title": _CONTENT,
    "Formula": "Please write out the expression of the formula in the image using LaTeX format.",
    "Table": "Please extract the table from the image and represent it in OTSL format.",
    "LAYOUT": "Please output the categories and coordinates of the document elements in reading order.",
    "END2END": "List the document elements in reading order, including their categories, coordinates, and the content of each element.",
}
# File suffixes that are read, and the media types that are served.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
INPUT_SUFFIXES = (*IMAGE_SUFFIXES, "pdf")

_SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Unicode white space off both ends, U+001C to U+001F included."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){_SPACE}+\z", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+", "")


def has_repeated_ending(text: Column, longest: int = 250) -> Column:
    """Whether the last L characters stand at the end more than int(4 * (1 + 3 / L)) times, for an L up to ``longest``."""

    def found(chars: Column) -> Column:
        def at(size: Column) -> Column:
            times = (F.lit(5) + F.floor(F.lit(12) / size)).cast("int")
            most = (times - 1) * size
            # The character one length back differs for most lengths, so few stretches are compared.
            return (F.size(chars) >= times * size) & (F.get(chars, size) == F.get(chars, F.lit(0))) & (F.slice(chars, F.lit(1), most) == F.slice(chars, size + 1, most))

        # Five copies at least have to fit, so short texts need few lengths.
        lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.floor(F.size(chars) / 5)).cast("int"))
        return F.coalesce(F.when(F.size(chars) >= 5, F.exists(lengths, at)), F.lit(False))

    # The copies of no length reach further back than 5 * longest + 12; the characters are listed once a text, the last one first.
    return F.exists(F.array(F.split(F.reverse(F.right(text, F.lit(5 * longest + 12))), "")), found)


def is_repetitive(text: Column, cut: int = 50) -> Column:
    """A repeated ending of the whole text, or of a longer one without its last ``cut`` characters."""
    shorter = F.when(F.length(text) > cut, has_repeated_ending(F.left(text, F.length(text) - cut))).otherwise(F.lit(False))
    return has_repeated_ending(text) | shorter


# Commands before a formula's closing number, and spaces of which five or more are filler.
_BEFORE_NUMBER = ("\\quad", "\\qquad", "\\eqno")
_SPACERS = ("\\quad", "\\qquad")
_FILLER = 5


def clean_formula(raw: Column) -> Column:
    """struct(body, number): a LaTeX formula without dollars, filler and closing number.

    A closing ``(n)`` after a space command is the number; a ``\\tag`` goes without one, and takes
    an earlier number with it when it stands inside an environment. An opening environment is
    written again on lines of its own, closed even where it was not.
    """
    plain = strip(F.btrim(raw, F.lit("$")))
    for spacer in _SPACERS:
        plain = without_filler(plain, spacer, _FILLER)
    return let(strip(plain), lambda b: let(_without_number(b, F.lit(None).cast("string")), _without_environment))


def without_filler(text: Column, spacer: str, least: int) -> Column:
    """``least`` or more spacers in a row, with white space alone between them, as one spacer and a blank.

    The text is cut at the spacers and put together again piece by piece; a run that goes on is
    held back as it was written until a piece with something in it ends it.
    """
    start = lambda done: F.struct(done.alias("done"), F.lit(0).alias("run"), F.lit("").alias("held"))

    def add(state: Column, piece: Column) -> Column:
        run, held = state["run"] + 1, F.concat(state["held"], F.lit(spacer), piece)
        ended = F.concat(state["done"], F.when(run >= least, F.concat(F.lit(spacer + " "), lstrip(piece))).otherwise(held))
        return F.when(strip(piece) == "", F.struct(state["done"].alias("done"), run.alias("run"), held.alias("held"))).otherwise(start(ended))

    def end(state: Column) -> Column:
        return F.concat(state["done"], F.when(state["run"] >= least, F.lit(spacer + " ")).otherwise(state["held"]))

    def joined(pieces: Column) -> Column:
        return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start(pieces[0]), add, end)

    return F.when(F.contains(text, F.lit(spacer)), let(F.split(text, r"\Q" + spacer + r"\E"), joined)).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _before_last(text: Column, opening: str, closing: str) -> Column:
    """struct(head, inner) of a text that ends with ``closing``: around the last ``opening``, with neither of the two inside; else null."""
    cut = F.left(text, F.length(text) - 1)
    inner = F.substring_index(cut, opening, -1)
    whole = F.endswith(text, F.lit(closing)) & F.contains(cut, F.lit(opening)) & ~F.contains(inner, F.lit(closing))
    return F.when(whole, F.struct(F.left(cut, F.length(cut) - F.length(inner) - 1).alias("head"), inner.alias("inner")))


def _without_command(text: Column, commands: tuple[str, ...]) -> Column:
    """``text`` less the one of ``commands`` at its end, and the white space before it; null without one."""
    return F.coalesce(*[F.when(F.endswith(text, F.lit(c)), rstrip(F.left(text, F.length(text) - len(c)))) for c in commands])


def _without_number(body: Column, before: Column) -> Column:
    """struct(body, number) with a closing number or tag taken off; ``before`` stands where there is none."""

    def found(end: Column) -> Column:
        numbered = let(_before_last(end, "(", ")"), lambda n: F.struct(_without_command(rstrip(n["head"]), _BEFORE_NUMBER).alias("body"), F.nullif(n["inner"], F.lit("")).alias("number")))
        tagged = let(_before_last(end, "{", "}"), lambda n: F.struct(_without_command(n["head"], ("\\tag",)).alias("body"), F.lit(None).cast("string").alias("number")))
        as_it_is = F.struct(body.alias("body"), before.alias("number"))
        return let(F.array(numbered, tagged, as_it_is), lambda ways: F.filter(ways, lambda w: w["body"].isNotNull())[0])

    return F.when(body.isNotNull(), let(rstrip(body), found))


def _environment(body: Column) -> Column:
    """The name of the environment that ``body`` opens with; empty without one."""
    rest = F.substring(body, len("\\begin{") + 1, 1 << 30)
    return F.when(F.startswith(body, F.lit("\\begin{")) & F.contains(rest, F.lit("}")), F.substring_index(rest, "}", 1)).otherwise(F.lit(""))


def _without_environment(outer: Column) -> Column:
    def inside(env: Column) -> Column:
        closing = F.concat(F.lit(r"\end{"), env, F.lit("}"))
        whole = let(lstrip(F.substring(outer["body"], F.length(env) + len("\\begin{}") + 1, F.length(outer["body"]))), lambda x: let(rstrip(x), lambda t: F.when(F.endswith(t, closing), rstrip(F.left(t, F.length(t) - F.length(closing)))).otherwise(x)))
        inner = F.when(env == "", outer["body"]).otherwise(whole)

        def closed(got: Column) -> Column:
            body = F.when(env == "", got["body"]).otherwise(F.concat(F.lit(r"\begin{"), env, F.lit("}\n"), got["body"], F.lit("\n"), closing))
            return F.struct(body.alias("body"), got["number"].alias("number"))

        return let(let(inner, lambda b: _without_number(b, outer["number"])), closed)

    return let(_environment(outer["body"]), inside)


def format_block(label: Column, raw: Column, prompted: Column, table: Column, image: Column) -> Column:
    """A block's content in Markdown by its label. ``table`` and ``image`` are used for those labels alone."""
    content = strip(F.coalesce(raw, F.lit("")))
    formula = let(clean_formula(content), lambda f: F.concat(F.lit("$$\n"), f["body"], F.lit("\n$$\n"), F.coalesce(f["number"], F.lit(""))))
    return (
        F.when(label == "Formula", formula)
        .when(label == "Table", table)
        .when(label == "Picture", F.concat(F.lit("![image]("), image, F.lit(")")))
        .when(label == "Title", F.concat(F.lit("# "), F.replace(content, F.lit("\n"), F.lit("\n# "))))
        .when(label == "Section-header", F.concat(F.lit("## "), F.replace(content, F.lit("\n"), F.lit("\n## "))))
        .when(~prompted, F.lit(""))
        .otherwise(content)
    )


@F.pandas_udf(T.StringType())
def _shortened(stem: pd.Series, suffix: pd.Series, most: pd.Series) -> pd.Series:
    out = []
    for s, x, m in zip(stem, suffix, most, strict=True):
        tail = "_" + hashlib.sha256((s + x).encode()).hexdigest()[:10] + x
        room = int(m) - len(tail.encode())
        out.append((s.encode()[:room].decode(errors="ignore").rstrip(" .") or "artifact") + tail if room > 0 else None)
    return pd.Series(out, dtype=object)


def artifact_name(stem: Column, suffix: Column, most_bytes: int = 255) -> Column:
    """stem + suffix if it fits, else a shortened stem with a digest; null if the suffix leaves no room."""
    whole = F.concat(stem, suffix)
    return F.when(F.octet_length(whole) <= most_bytes, whole).otherwise(_shortened(stem, suffix, F.lit(most_bytes)))


def upload_name(name: Column) -> Column:
    """A safe file name: base name only, plain characters, bounded stem, known-size suffix."""
    base = F.regexp_extract(F.coalesce(F.nullif(name, F.lit("")), F.lit("upload.bin")), r"([^/\\]*)\z", 1)
    has_suffix = base.rlike(r"^.*[^.].*\.[^.]*[^.]\z|^[^.]+\.[^.]+\z") & ~base.rlike(r"^\.+[^.]*\z")
    suffix = F.when(has_suffix, F.lower(F.regexp_extract(base, r"(\.[^.]+)\z", 1))).otherwise(F.lit(""))
    stem = F.when(has_suffix, F.regexp_replace(base, r"\.[^.]+\z", "")).otherwise(base)
    plain = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+\z", "")
    plain = F.when(plain == "", F.lit("upload")).otherwise(plain)
    return F.concat(F.left(plain, F.lit(128)), F.when(F.length(suffix).between(2, 16), suffix).otherwise(F.lit(".bin")))


def server_url(raw: Column) -> Column:
    """http(s) address without closing slashes; http where none is given and for local https; null for other schemes."""
    text = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"/+\z", "")
    full = F.when(text == "", text).when(F.instr(text, "://") == 0, F.concat(F.lit("http://"), text)).otherwise(text)
    scheme = F.lower(F.regexp_extract(full, r"^([^:]*)://", 1))
    local = full.rlike(r"(?i)^https://(127\.0\.0\.1|localhost|0\.0\.0\.0)(:|/|\z)")
    return F.when(full == "", full).when(local, F.regexp_replace(full, r"(?i)^https", "http")).when(scheme.isin("http", "https"), full)


def image_repository(reference: Column) -> Column:
    """An image reference without digest and tag; a registry's port stays."""
    return F.regexp_replace(F.regexp_replace(reference, r"@.*\z", ""), r":[^/:]*\z", "")


def positive_int(value: Column, default: int = 1) -> Column:
    number = strip(value).try_cast("int")
    return F.when(number > 0, number).otherwise(F.lit(default))


def retry_temperature(attempt: Column) -> Column:
    return F.least((attempt + 1) * F.lit(0.2), F.lit(0.8))


def backoff_seconds(base: float, attempt: Column, most: float = 30.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def script_ratio(text: Column, letters: str) -> Column:
    """Share of a character class among letters, data URIs left out; 0 without letters."""
    plain = F.regexp_replace(text, r"data:[^)\s]+", "")
    total = F.regexp_count(plain, F.lit(r"\p{L}"))
    return F.when(total > 0, F.regexp_count(plain, F.lit(letters)) / total).otherwise(F.lit(0.0))


# The blocks of Arabic script and a data URI of an image.
_ARABIC = r"[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF]"
_IMAGE_URI = r"data:image/[^;\s)]+;base64,[A-Za-z0-9+/=]+"


def is_arabic(text: Column, least: float = 0.2) -> Column:
    """Whether Arabic characters make up ``least`` of all letters or more, images left out; so they do where there are no letters."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), _IMAGE_URI, "")
    found, letters = F.regexp_count(plain, F.lit(_ARABIC)), F.regexp_count(plain, F.lit(r"\p{L}"))
    return (found > 0) & ((letters == 0) | (found >= letters * least))


def media_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1))
    return F.when(suffix.isin(*IMAGE_SUFFIXES), F.lit("image")).when(suffix == "pdf", F.lit("pdf")).otherwise(F.lit("unsupported"))


def truthy(value: Column) -> Column:
    return F.lower(strip(value)).isin("1", "true", "yes", "on")


def path_segments_encoded(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def question_prompt(question: Column) -> Column:
    """The chat text that goes to a vision model (fixed wording)."""
    return F.concat(
        F.lit("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n<|vision_start|><|image_pad|><|vision_end|>"), question, F.lit("<|im_end|>\n<|im_start|>assistant\n")
    )
