"""Queries for the library's own operators over the fixture tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import geometry, text
from quirelake.operators import blocks, curation, jobs, layout, retry, tables
from quirelake.session import kept_in_buckets, shared_dir
from quirelake.sources import files
from quirelake.streaming import batches, completion

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_BLOCKS = r"""
lines as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
cut as (select doc_id, len(l) as n_blocks, unnest(l) as raw, generate_subscripts(l, 1) - 1 as block_idx from lines),
blocks as (select *, case when block_idx = 0 then 'Title' when block_idx = n_blocks - 1 then 'Page-footer' when block_idx % 7 = 0 then 'Section-header' else 'Text' end as label from cut),
formatted as (select *, case label when 'Title' then '# ' when 'Section-header' then '## ' else '' end || regexp_replace(raw, '^\s+|\s+$', '', 'g') as content from blocks)
"""


@query(f"""
with {_BLOCKS},
shown as (select doc_id, block_idx, regexp_replace(content, '^\\s+|\\s+$', '', 'g') as content from formatted where label not in ('Page-header', 'Page-footer')),
full_ as (select * from shown where content <> '')
select doc_id, count(*) as n_blocks, sha256(replace(string_agg(content, chr(10) || chr(10) order by block_idx) || chr(10), '\ufffd', '')) as md_sha from full_ group by doc_id
""")
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown from their routed blocks (the flagship)."""
    made = blocks.markdown(blocks.formatted(blocks.blocks_of(read(spark, sf_dir, "documents"))), ["block_idx"])
    return made.select("doc_id", "n_blocks", F.sha2("markdown", 256).alias("md_sha"))


@query(f"""
with {_BLOCKS},
dim as (select unnest(['Caption', 'List-item', 'Page-footer', 'Page-header', 'Section-header', 'Text', 'Title', 'Formula', 'Table', 'LAYOUT', 'END2END']) as label)
select b.label, d.label is not null as need_infer, count(*) as n_blocks, count(distinct doc_id) as n_docs
from (select doc_id, case when block_idx % 11 = 5 then 'Picture' when block_idx % 13 = 6 then 'Footnote' else label end as label from blocks) b left join dim d on b.label = d.label group by all
""")
def block_routing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by label and by whether a model would see them; some are made pictures and footnotes."""
    at = F.col("block_idx")
    some = blocks.blocks_of(read(spark, sf_dir, "documents")).withColumn("label", F.when(at % 11 == 5, "Picture").when(at % 13 == 6, "Footnote").otherwise(F.col("label")))
    return blocks.routed(some).groupBy("label", "need_infer").agg(F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""
with {_BLOCKS}
select doc_id, case when count(*) <= 10 then '[1000,' || (200 * count(*)) || ']' else '[[1000,2000],[1000,' || (200 * (count(*) - 10)) || ']]' end as image_size,
  sha256(string_agg(block_idx || ':' || label || ':' || length(content), ';' order by block_idx)) as layouts_sha, count(*) as n_layouts from formatted group by doc_id
""")
def result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records: ordered layouts, and a size that is a pair for one page and a list for more."""
    made = blocks.formatted(blocks.blocks_of(read(spark, sf_dir, "documents")))
    own = made.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_idx", "label", F.length("content").alias("n")))).alias("b"))
    n = F.size("b")
    sizes = F.when(n <= 10, F.array(F.array(F.lit(1000), 200 * n))).otherwise(F.array(F.array(F.lit(1000), F.lit(2000)), F.array(F.lit(1000), 200 * (n - 10))))
    told = F.array_join(F.transform("b", lambda x: F.concat_ws(":", x["block_idx"].cast("string"), x["label"], x["n"].cast("string"))), ";")
    return own.select("doc_id", blocks.collapsed_size(sizes).alias("image_size"), F.sha2(told, 256).alias("layouts_sha"), n.cast("long").alias("n_layouts"))


@query(f"""
with {_BLOCKS}
select doc_id, block_idx // 5 as page_idx, block_idx % 5 as block_idx, '../images/doc' || doc_id || '_sub' || (row_number() over (partition by doc_id order by block_idx) - 1) || '.jpg' as image_ref
from blocks where block_idx % 3 = 1
""")
def picture_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures (every third block) numbered through their document in reading order."""
    some = blocks.blocks_of(read(spark, sf_dir, "documents")).where("block_idx % 3 = 1")
    paged = some.select("doc_id", F.floor(F.col("block_idx") / 5).alias("page_idx"), (F.col("block_idx") % 5).cast("long").alias("block_idx"))
    name = blocks.picture_name(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), blocks.picture_number())
    return paged.select("doc_id", "page_idx", "block_idx", name.alias("image_ref"))


_REPEATED = "len(list_filter(range(1, 251), lambda k: length({t}) >= (5 + 12 // k) * k and right({t}, (5 + 12 // k) * k) = repeat(right({t}, k), 5 + 12 // k))) > 0"


@query(f"""
with t as (select doc_id, case when doc_id % 4 = 0 then text || repeat(substr(text, 1 + doc_id % 7, 1 + doc_id % 20), 5 + doc_id % 9) when doc_id % 4 = 1 then text || repeat('ab', 20) || substr(text, 1, 50) else text end as t from documents),
s as (select doc_id, t, case when length(t) > 50 then left(t, length(t) - 50) else '' end as u from t)
select doc_id, {_REPEATED.format(t='t')} as whole, {_REPEATED.format(t='t')} or (length(t) > 50 and {_REPEATED.format(t='u')}) as repetitive from s
""")
def repeated_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, half of them with made-up repeated endings, some hidden behind fifty other characters."""
    t, i = F.col("text"), F.col("doc_id")
    made = (
        F.when(i % 4 == 0, F.concat(t, F.repeat(F.substring(t, (1 + i % 7).cast("int"), (1 + i % 20).cast("int")), (5 + i % 9).cast("int"))))
        .when(i % 4 == 1, F.concat(t, F.repeat(F.lit("ab"), F.lit(20)), F.substring(t, F.lit(1), F.lit(50))))
        .otherwise(t)
    )
    some = read(spark, sf_dir, "documents").select("doc_id", made.alias("t"))
    return some.select("doc_id", text.has_repeated_ending(F.col("t")).alias("whole"), text.is_repetitive(F.col("t")).alias("repetitive"))


def _sides(a: str, b: str, size: str) -> tuple[str, str]:
    low, high = (f"cast(round_even(cast({f}({a} / 1000.0::double * {size}, {b} / 1000.0::double * {size}) as double), 0) as bigint)" for f in ("least", "greatest"))
    start = f"greatest(0, least({low}, case when {size} > 0 then {size} - 1 else 0 end))"
    return start, f"greatest({start} + 1, least({high}, {size}))"


_X, _Y = _sides("x1", "x2", "w"), _sides("y1", "y2", "h")


@query(f"""
with b as (select l_orderkey, l_linenumber, l_quantity * 20 as x1, l_extendedprice % 1100 as y1, l_discount * 10000 as x2, l_tax * 12500 + l_quantity as y2, 600 + l_partkey % 900 as w, 800 + l_suppkey % 90 as h from lineitem)
select l_orderkey, l_linenumber, cast({_X[0]} as int) as x1, cast({_Y[0]} as int) as y1, cast({_X[1]} as int) as x2, cast({_Y[1]} as int) as y2 from b
""")
def bbox_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on the 0-1000 grid, some reversed or outside, in pixels of their page."""
    c = F.col
    box = geometry.box_to_pixels(c("l_quantity") * 20, c("l_extendedprice") % 1100, c("l_discount") * 10000, c("l_tax") * 12500 + c("l_quantity"), 600 + c("l_partkey") % 900, 800 + c("l_suppkey") % 90)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("""
with p as (select p_partkey, 100 + p_size * 40 as w, 80 + p_partkey % 1500 as h from part),
s as (select *, case when w * h < 200000 then sqrt(200000 / (w * h)) when w * h > 1003520 then sqrt(1003520 / (w * h)) else 1.0::double end as k from p)
select p_partkey, cast(trunc(w * k) as int) as width, cast(trunc(h * k) as int) as height, cast(floor((w // 3) / (w / 2) * (w * k) + 0.5) as bigint) as crop_x from s
""")
def image_resize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes scaled into a range of pixel counts, and a crop edge in natural pixels."""
    own = read(spark, sf_dir, "part").select("p_partkey", (100 + F.col("p_size") * 40).alias("w"), (80 + F.col("p_partkey") % 1500).alias("h"))
    w, h = F.col("w"), F.col("h")
    new = geometry.resized(w, h, F.lit(200000), F.lit(1003520))
    scale = F.when(w * h < 200000, F.sqrt(F.lit(200000) / (w * h))).when(w * h > 1003520, F.sqrt(F.lit(1003520) / (w * h))).otherwise(F.lit(1.0))
    crop = geometry.display_to_natural(F.floor(w / 3), w / 2, w * scale)
    return own.select("p_partkey", new.alias("s"), crop.alias("crop_x")).select("p_partkey", "s.width", "s.height", "crop_x")


@query(r"""
with k as (select p_partkey as k, p_partkey % 6 as c from part)
select k as p_partkey, case c when 0 then 'x_' || k || '=1' when 1 then 'a+' || k when 2 then 'b' || k when 3 then '\begin{eq}' || chr(10) || 'y' || k || chr(10) || '\end{eq}' when 4 then 'p\quad q' || k else '\begin{al}' || chr(10) || 'z' || k || chr(10) || '\end{al}' end as body,
  case c when 1 then k::varchar when 3 then '7' else null end as number from k
""")
def formula_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LaTeX formulas of each kind: plain, numbered, tagged, in an environment, padded, unclosed."""
    k = F.col("p_partkey").cast("string")
    c = F.col("p_partkey") % 6
    raw = (
        F.when(c == 0, F.concat(F.lit("$$ x_"), k, F.lit("=1 $$")))
        .when(c == 1, F.concat(F.lit("a+"), k, F.lit(r" \quad ("), k, F.lit(")")))
        .when(c == 2, F.concat(F.lit("b"), k, F.lit(r" \tag{"), k, F.lit("}")))
        .when(c == 3, F.concat(F.lit("\\begin{eq}\ny"), k, F.lit("\n\\end{eq} \\eqno (7)")))
        .when(c == 4, F.concat(F.lit(r"p\quad \quad \quad \quad \quad \quad q"), k))
        .otherwise(F.concat(F.lit(r"\begin{al}z"), k))
    )
    return read(spark, sf_dir, "part").select("p_partkey", text.clean_formula(raw).alias("f")).select("p_partkey", "f.body", "f.number")


@query(r"""
with p as (select page_id, url, regexp_replace(url, '^.*/', '') as base from pages),
n as (select page_id, repeat(coalesce(nullif(base, ''), 'index') || '_', 1 + page_id % 40) as stem from p)
select page_id, case when strlen(stem || '_results.zip') <= 255 then stem || '_results.zip' else rtrim(left(stem, 255 - 11 - strlen('_results.zip')), ' .') || '_' || left(sha256(stem || '_results.zip'), 10) || '_results.zip' end as artifact,
  regexp_matches(left(sha256(url), 12), '^[0-9a-f-]+$') as valid_id from n join p using (page_id)
""")
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of addresses, cut to 255 bytes with a digest where they are longer."""
    base = F.coalesce(F.nullif(F.regexp_extract("url", r"([^/]*)\z", 1), F.lit("")), F.lit("index"))
    stem = F.repeat(F.concat(base, F.lit("_")), (1 + F.col("page_id") % 40).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", text.artifact_name(stem, F.lit("_results.zip")).alias("artifact"), F.left(F.sha2("url", 256), F.lit(12)).rlike(r"^[0-9a-f-]+\z").alias("valid_id"))


@query(r"""
select doc_id, round(case when length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0 then length(regexp_replace(text, '[^à-ÿÀ-Þ]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g'))::double else 0 end, 9) as ratio from documents
""")
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of accented letters among letters (the same expression serves other scripts)."""
    return read(spark, sf_dir, "documents").select("doc_id", F.round(text.script_ratio(F.col("text"), "[à-ÿÀ-Þ]"), 9).alias("ratio"))


_SPANS = """
with c as (select r.r_regionkey, r.r_name, n.n_name, row_number() over (partition by r.r_regionkey order by n.n_nationkey) as k from region r join nation n on n.n_regionkey = r.r_regionkey)
"""


def _region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id, otsl: a head over two columns, then a region beside its nations with their keys."""
    joined = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = joined.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = F.transform("n", lambda x, i: F.concat(F.when(i == 0, F.concat(F.lit("<fcel>"), F.col("r_name"))).otherwise(F.lit("<ucel>")), F.lit("<fcel> "), x["n_name"], F.lit(" <ecel><nl>")))
    return own.select(F.col("r_regionkey").alias("table_id"), F.concat(F.lit("<fcel>Region & nations<lcel><fcel>#<nl>"), F.array_join(rows, "")).alias("otsl"))


@query(_SPANS + """
select r_regionkey as table_id, 0 as r, 0 as c, 'Region & nations' as text, 1 as rowspan, 2 as colspan from region
union all select r_regionkey, 0, 2, '#', 1, 1 from region
union all select r_regionkey, 1, 0, r_name, cast(count(*) as int), 1 from c group by r_regionkey, r_name
union all select r_regionkey, cast(k as int), 1, n_name, 1, 1 from c
union all select r_regionkey, cast(k as int), 2, '', 1, 1 from c
""")
def otsl_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with spans of well-formed tables, by windows alone."""
    return tables.otsl_cells(_region_tables(spark, sf_dir))


@query(_SPANS + """
select r_regionkey as table_id, '<table><tr><td colspan="2">Region &amp; nations</td><td>#</td></tr>' || string_agg('<tr>' || case when k = 1 then '<td' || case when n > 1 then ' rowspan="' || n || '"' else '' end || '>' || r_name || '</td>' else '' end || '<td>' || n_name || '</td><td></td></tr>', '' order by k) || '</table>' as html
from (select *, count(*) over (partition by r_regionkey) as n from c) group by r_regionkey
""")
def otsl_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region_tables(spark, sf_dir).select("table_id", tables.otsl_to_html("otsl").alias("html"))


@query(_SPANS + """
select r_regionkey as table_id, '<fcel>Region & nations<lcel><fcel>#<nl>' || string_agg(case when k = 1 then '<fcel>' || r_name else '<ucel>' end || '<fcel>' || n_name || '<ecel><nl>', '' order by k) as otsl from c group by r_regionkey
""")
def html_to_otsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip: markup to HTML and back, cell texts trimmed on the way."""
    return _region_tables(spark, sf_dir).select("table_id", tables.html_to_otsl(tables.otsl_to_html("otsl")).alias("otsl"))


@query("""
select l_orderkey, cast(count(*) as int) as n_items, round(sum(l_quantity), 4) as sum_x1, max(l_returnflag) as last_label from lineitem group by l_orderkey
""")
def tolerant_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-like lists per order: whole, inside prose, as tuples, or broken off after the last item."""
    c = F.col
    own = F.concat(F.lit("{'bbox': "), F.lit("("), c("l_quantity").cast("string"), F.lit(", 2, '3', 4), 'label': '"), c("l_returnflag"), F.lit("', 'content': 'a] "), F.concat_ws(" ", c("l_linenumber"), c("l_partkey"), c("l_extendedprice")), F.lit("'}"))
    one = F.when(c("l_orderkey") % 4 == 2, own).otherwise(F.replace(F.replace(own, F.lit("("), F.lit("[")), F.lit(")"), F.lit("]")))
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_returnflag", "l_linenumber", one.alias("i")))).alias("i"))
    body = F.array_join(F.transform("i", lambda x: x["i"]), ", ")
    k = c("l_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("["), body, F.lit("]"))).when(k == 1, F.concat(F.lit("Here: ["), body, F.lit(", {'bbox': [1, 2"))).otherwise(F.concat(F.lit(" ["), body, F.lit("]\n")))
    found = lists.select("l_orderkey", layout.finite(layout.tolerant_items(raw)).alias("items"))
    return found.select("l_orderkey", F.size("items").alias("n_items"), F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["x1"]), 4).alias("sum_x1"), F.element_at("items", -1)["label"].alias("last_label"))


@query("select d.doc_id, d.source, cast(1 + d.n_chars // 3000 as bigint) as page_count from documents d anti join labels l on d.doc_id = l.doc_id")
def skip_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a finished result (here: without a label), with their page counts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", (1 + F.floor(F.col("n_chars") / 3000)).cast("long").alias("page_count"))
    return files.pending(docs, read(spark, sf_dir, "labels"), "doc_id")


@query("""
select doc_id, p as page_idx, p + 1 as page_num, printf('page_%03d.png', p + 1) as cache_name from (select doc_id, cast(unnest(range(0, 1 + n_chars // 3000)) as int) as p from documents)
""")
def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page with its number and the name of its cached image."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (1 + F.floor(F.col("n_chars") / 3000)).cast("int").alias("page_count"))
    return files.pages_of(docs).select("doc_id", "page_idx", "page_num", "cache_name")


@query(f"""
with {_BLOCKS}
select doc_id, count(*) as n_blocks, count(*) filter (block_idx % 4 <> 3) as n_read, sum(case when block_idx % 4 <> 3 then length(raw) else 0 end)::bigint as characters from blocks group by doc_id
""")
def recognition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of two rounds joined back to their blocks; a quarter of them is missing and counts as empty.

    Blocks and answers lie in the same buckets, so each round joins without a shuffle.
    """
    place = ["doc_id", "block_idx"]
    own = blocks.blocks_of(read(spark, sf_dir, "documents"))
    kept = lambda df: kept_in_buckets(df, place, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = kept(own.drop("raw"))
    first, again = (kept(own.where(f"block_idx % 4 = {k}" if k else "block_idx % 4 in (0, 2)").select(*place, "raw")) for k in (0, 1))
    got = blocks.merged(asked, first, place).join(again.withColumnRenamed("raw", "later"), place, "left").withColumn("raw", F.coalesce("later", "raw"))
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("block_idx") % 4 != 3).alias("n_read"), F.sum(F.length("raw")).cast("long").alias("characters"))


@query("""
select o_orderkey as key, cast(case when o_orderkey % 3 = 0 then least(o_orderkey % 4, 3) else 0 end as int) as attempt, false as repetitive,
  'text ' || o_orderkey || ' at ' || printf('%.1f', case when o_orderkey % 3 = 0 then least(0.2 * (o_orderkey % 4), 0.8) else 0 end) as raw from orders
""")
def retry_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in model retried over repetitive answers with rising temperature."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit("What?").alias("question"))
    return retry.with_retries(rows, retry.stand_in).select("key", "attempt", "repetitive", "raw")


@query("""
with p as (select doc_id, cast(unnest(range(0, greatest(1, (length(coalesce(text, '')) + 39) // 40))) as int) as page_idx, coalesce(text, '') as text from documents),
o as (select doc_id, page_idx, regexp_replace(substr(text, 1 + page_idx * 40, 40), '^\\s+|\\s+$', '', 'g') as raw from p),
a as (select doc_id, count(*) as n, string_agg('## Page ' || (page_idx + 1) || chr(10) || chr(10) || raw, chr(10) || chr(10) order by page_idx) as many, min(raw) as one from o group by doc_id),
m as (select doc_id, case when n = 1 then one else regexp_replace(many, '^\\s+|\\s+$', '', 'g') end as t from a)
select doc_id, case when t = '' then t else t || chr(10) end as markdown from m
""")
def single_task_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-task outputs, a page for every forty characters of the text, with headings where there are several."""
    pages = F.when(F.length("text") > 0, F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0))).otherwise(F.array(F.lit("")))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(pages).alias("page_idx", "raw"))
    return blocks.pages_markdown(docs)


_STATUS = "case event_type when 'signup' then 'queued' when 'view' then 'processing' when 'click' then 'extracting' when 'purchase' then 'succeeded' else 'failed' end"


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("user_id % 50 as session_id", "user_id as job_id", f"{_STATUS} as status", "ts", "event_id")


@query(f"select user_id as job_id, max_by({_STATUS}, (ts, event_id)) as status, max(ts) as last_event from events group by user_id")
def job_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every job from its newest event."""
    return jobs.latest_status(_job_events(spark, sf_dir), "job_id", "status", ["ts", "event_id"])


@query(f"""
with l as (select user_id as job_id, max_by({_STATUS}, (ts, event_id)) as status, max(ts) as last_event from events group by user_id)
select job_id % 50 as session_id, job_id, status, row_number() over (partition by job_id % 50 order by last_event desc, job_id) as place from l where status in ('queued', 'processing', 'extracting')
""")
def jobs_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active jobs of every session, newest first."""
    from pyspark.sql import Window

    latest = jobs.latest_status(_job_events(spark, sf_dir), "job_id", "status", ["ts", "event_id"]).where(F.col("status").isin(*jobs.ACTIVE))
    own = latest.withColumn("session_id", F.col("job_id") % 50)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("last_event"), "job_id")).cast("long")
    return own.select("session_id", "job_id", "status", place.alias("place"))


@query(f"""
with l as (select user_id as id, max_by({_STATUS}, (ts, event_id)) as status, floor(epoch(max(ts)))::bigint as mtime from events group by user_id)
select id, mtime from l where mtime < epoch(timestamp '2024-01-31 00:00:00')::bigint - 86400 and id not in (select id from l where status in ('queued', 'processing', 'extracting'))
""")
def expired_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces past their time, those of active jobs excepted."""
    latest = jobs.latest_status(_job_events(spark, sf_dir), "job_id", "status", ["ts", "event_id"]).select(F.col("job_id").alias("id"), "status", F.unix_timestamp("last_event").alias("mtime"))
    now = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return jobs.expired(latest.select("id", "mtime"), latest.where(F.col("status").isin(*jobs.ACTIVE)).select("id"), now, 86400)


@query("""
with e as (select event_id, case event_type when 'error' then 'ServiceBusyError' when 'click' then 'InvalidMediaError' when 'view' then 'ArtifactNotFoundError' when 'signup' then 'UploadTooLargeError' else 'SomethingElse' end as error from events)
select error, cast(case error when 'ServiceBusyError' then 429 when 'ArtifactNotFoundError' then 404 when 'UploadTooLargeError' then 413 else 400 end as int) as http_status,
  case error when 'ServiceBusyError' then 'SERVICE_BUSY' when 'InvalidMediaError' then 'INVALID_MEDIA' when 'ArtifactNotFoundError' then 'ARTIFACT_NOT_FOUND' when 'UploadTooLargeError' then 'UPLOAD_TOO_LARGE' else 'INVALID_REQUEST' end as internal_code,
  cast(case when error = 'ServiceBusyError' then 1 end as int) as retry_after, count(*) as n from e group by all
""")
def error_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with their status and code, anything unknown as a bad request."""
    named = "case event_type when 'error' then 'ServiceBusyError' when 'click' then 'InvalidMediaError' when 'view' then 'ArtifactNotFoundError' when 'signup' then 'UploadTooLargeError' else 'SomethingElse' end as error"
    return jobs.envelopes(read(spark, sf_dir, "events").selectExpr(named)).groupBy("error", "http_status", "internal_code", "retry_after").agg(F.count(F.lit(1)).alias("n"))


@query("""
with m as (select doc_id, source, n_chars, case when doc_id % 10 = 0 then '../' || doc_id || '.md' when doc_id % 10 = 1 then '/' || doc_id else 'docs/' || doc_id || '.md' end as member from documents),
s as (select *, not (member like '/%') and not list_contains(string_split(member, '/'), '..') as safe from m)
select doc_id, source, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding)::bigint as running, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) <= 50000 as fits from s where safe
""")
def archive_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe members of archives (one per source) with the bytes unpacked so far and whether they fit."""
    i = F.col("doc_id").cast("string")
    member = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("../"), i, F.lit(".md"))).when(F.col("doc_id") % 10 == 1, F.concat(F.lit("/"), i)).otherwise(F.concat(F.lit("docs/"), i, F.lit(".md")))
    safe = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", member.alias("member")).where(jobs.safe_member(F.col("member")))
    return jobs.within_budget(safe, "source", "doc_id", "n_chars", 50000).select("doc_id", "source", "running", "fits")


@query("""
select l_orderkey as image, cast(sum(l_partkey) as bigint) as total_bytes, coalesce(max(l_partkey) filter (l_suppkey % 10 <> 0), 0) as largest_own_layer, count(*) as n_layers from lineitem group by l_orderkey
""")
def manifest_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of images (orders), those of the base image left out of the largest."""
    layers = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_suppkey").alias("digest"), F.col("l_partkey").alias("size"))
    return jobs.manifest_measures(layers, layers.where("digest % 10 = 0"))


@query("""
select conv_id, count(*) filter (role = 'assistant') as n_assistant, cast(sum(length(text)) as bigint) as characters, string_agg(role, ',' order by turn) as roles from conversations group by conv_id
""")
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat records, read back from their JSON."""
    made = curation.chat_records(read(spark, sf_dir, "conversations"))
    m = F.from_json("record", "struct<messages:array<struct<role:string,content:string>>>")["messages"]
    return made.select("conv_id", "n_assistant", F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("characters"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"))


@query(f"""
with {_BLOCKS},
p as (select doc_id as page_id, block_idx, raw as p1, case when block_idx % 5 = 2 then raw || ' extra' else raw end as p2, case when block_idx % 19 = 7 then 'quite different' when block_idx % 5 = 3 then raw || ' more words' else raw end as p3 from blocks where raw <> ''),
w as (select *, list_distinct(string_split(p1, ' ')) as a, list_distinct(string_split(p2, ' ')) as b, list_distinct(string_split(p3, ' ')) as c from p),
s as (select *, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as s12, len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))) as s13, len(list_intersect(b, c)) / len(list_distinct(list_concat(b, c))) as s23 from w),
g as (select *, (s12 + s13 + s23) / 3 as agreement, (s12 + s13) / 2 as m1, (s12 + s23) / 2 as m2, (s13 + s23) / 2 as m3 from s)
select page_id, block_idx, round(agreement, 9) as agreement, length(case when m1 = greatest(m1, m2, m3) then p1 when m2 = greatest(m1, m2, m3) then p2 else p3 end) as n_chosen
from g where page_id not in (select page_id from g where agreement < 0.6)
""")
def agreement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three predictions per block; pages with a block in dispute go, the closest prediction stays."""
    own = blocks.blocks_of(read(spark, sf_dir, "documents")).where("raw <> ''")
    at, raw = F.col("block_idx"), F.col("raw")
    three = own.select(
        F.col("doc_id").alias("page_id"), at.cast("long").alias("block_idx"), raw.alias("p1"), F.when(at % 5 == 2, F.concat(raw, F.lit(" extra"))).otherwise(raw).alias("p2"),
        F.when(at % 19 == 7, F.lit("quite different")).when(at % 5 == 3, F.concat(raw, F.lit(" more words"))).otherwise(raw).alias("p3"),
    )
    return curation.agreed(three).select("page_id", "block_idx", F.round("agreement", 9).alias("agreement"), F.length("chosen").cast("long").alias("n_chosen"))


@query("""
with v as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding) as x from embeddings), c as (select vec_id, x, i % 4 as ch, i // 4 as q from v)
select vec_id, cast((q // 8) * 2 + (q // 2) % 2 as int) as "row", cast(((q // 4) % 2) * 2 + q % 2 as int) as col, cast(ch as int) as channel, round(x::double, 5) + 0.0 as x from c
""")
def feature_map_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read as a 2 x 2 grid of 2 x 2 cells with 4 channels, put in image order."""
    flat = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    at = geometry.grid_position(F.col("i"), w=2, m1=2, m2=2, channels=4)
    return flat.select("vec_id", at.alias("g"), (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x")).select("vec_id", "g.row", "g.col", "g.channel", "x")


@query("select doc_id, cast(1 + n_chars // 3000 as bigint) as pages, cast(n_chars as bigint) as characters from documents where n_chars > 0")
def stream_doc_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents as a stream; each document comes out once, when its last page is in."""
    import uuid

    docs = batches.file_stream(spark, f"{sf_dir}/documents.parquet")
    n = F.col("n_chars")
    pages = docs.where("n_chars > 0").select("doc_id", (1 + F.floor(n / 3000)).cast("long").alias("page_count"), "n_chars", F.explode(F.sequence(F.lit(0), F.floor(n / 3000).cast("int"))).alias("p"))
    sized = pages.select("doc_id", F.col("p").alias("page"), "page_count", F.when(F.col("p") < F.col("page_count") - 1, F.lit(3000)).otherwise(n - 3000 * (F.col("page_count") - 1)).cast("long").alias("characters"))
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return batches.drained(completion.completed(sized), folder)


@query(r"""
with p as (select page_id, regexp_extract_all(html, '(?s)<h1\b[^>]*>.*?</h1>|<h2\b[^>]*>.*?</h2>|<p\b[^>]*>.*?</p>|<li\b[^>]*>.*?</li>') as parts from pages),
c as (select page_id, unnest(parts) as part, cast(generate_subscripts(parts, 1) - 1 as int) as block_idx from p),
t as (select page_id, block_idx, regexp_extract(part, '^<(\w+)', 1) as tag, regexp_replace(regexp_replace(part, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') as plain from c)
select page_id, block_idx, case tag when 'h1' then 'Title' when 'h2' then 'Section-header' when 'li' then 'List-item' else 'Text' end as label, replace(replace(replace(replace(plain, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as content from t
""")
def pages_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of raw web pages: text between tags, in order, with a label by the tag that opened it."""
    parts = F.regexp_extract_all("html", F.lit(r"(?s)<(h1|h2|p|li)\b[^>]*>(.*?)</\1>"), 0)
    cut = read(spark, sf_dir, "pages").select("page_id", F.posexplode(parts).alias("block_idx", "part"))
    tag = F.regexp_extract("part", r"^<(\w+)", 1)
    label = F.when(tag == "h1", "Title").when(tag == "h2", "Section-header").when(tag == "li", "List-item").otherwise("Text")
    plain = text.strip(F.regexp_replace("part", r"<[^>]*>", ""))
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(c))
    return cut.select("page_id", "block_idx", label.alias("label"), plain.alias("content"))


@query("""
with m as (select source || '/' || doc_id % (select greatest(200, count(*) // 5) from documents) as archive, doc_id, text from documents),
f as (select archive, 'docs/' || doc_id || '.md' as member, strlen(coalesce(text, '')) as size, sha256(coalesce(text, '')) as sha from m where doc_id % 10 <> 3
  union all select archive, 'images/' || doc_id || '.jpg', 4, sha256('jpeg') from m where doc_id % 25 = 0),
a as (select archive, count(*) + count(*) filter (doc_id % 25 = 0) as files from m group by archive),
t as (select archive, files, coalesce((select sum(size) from f where f.archive = a.archive), 0) as bytes from a)
select f.archive, member, size::bigint as size, sha, null as error from f join t using (archive) where files <= 5 and bytes <= 20000
union all select archive, null, 0, null, case when files > 5 then 'too many files' else 'over the extraction limit' end from t where files > 5 or bytes > 20000
""")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into archives and unpacked again under limits that some break; some suffixes are left out."""
    from quirelake.operators import archives

    i = F.col("doc_id").cast("string")
    docs = read(spark, sf_dir, "documents")
    # About five documents share a number, whatever the size of the table, so most archives stay within the limits.
    docs = docs.withColumn("archive", F.concat("source", F.lit("/"), (F.col("doc_id") % max(200, docs.count() // 5)).cast("string")))
    name = F.concat(F.lit("docs/"), i, F.when(F.col("doc_id") % 10 == 3, ".exe").otherwise(".md"))
    own = docs.select("archive", name.alias("member"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    pictures = docs.where("doc_id % 25 = 0").select("archive", F.concat(F.lit("images/"), i, F.lit(".jpg")).alias("member"), F.lit("jpeg").cast("binary").alias("content"))
    back = archives.unpacked(archives.pack(own.unionByName(pictures)), 5, 20_000, (".md", ".jpg"))
    return back.select("archive", "member", "size", F.sha2("content", 256).alias("sha"), "error")


@query("""
select doc_id, case doc_id % 5 when 0 then 'images/' || doc_id || '.jpg' when 1 then 'markdowns/' || doc_id || '.png' end as resolved from documents
""")
def asset_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of result files: siblings, parents, remote, escaping, unlisted."""
    from quirelake.functions import assets

    i = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 5
    asset = (
        F.when(kind == 0, F.concat(F.lit("../images/"), i, F.lit(".jpg?v=1")))
        .when(kind == 1, F.concat(F.lit("./"), i, F.lit(".png")))
        .when(kind == 2, F.concat(F.lit("https://far.example/"), i))
        .when(kind == 3, F.concat(F.lit("../../images/"), i, F.lit(".jpg")))
        .otherwise(F.concat(F.lit("missing/"), i))
    )
    files_ = F.array(F.concat(F.lit("images/"), i, F.lit(".jpg")), F.concat(F.lit("markdowns/"), i, F.lit(".png")))
    return read(spark, sf_dir, "documents").select("doc_id", assets.resolve_asset(F.lit("markdowns/document.md"), asset, files_).alias("resolved"))


@query("""
with p as (select p_partkey, 4 + 2 * (p_size % 3) as h, 6 + 2 * (p_size % 5) as w from part),
i as (select p_partkey, h, w, unnest(range(0, h * w)) as k from p)
select p_partkey, cast(k as int) as patch, cast((k // 4) // (w // 2) * 2 + (k % 4) // 2 as int) as "row", cast((k // 4) % (w // 2) * 2 + k % 2 as int) as col from i
""")
def patch_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and column of image patches walked by merge windows."""
    from quirelake.functions import assets

    own = read(spark, sf_dir, "part").select("p_partkey", (4 + 2 * (F.col("p_size") % 3)).alias("h"), (6 + 2 * (F.col("p_size") % 5)).alias("w"))
    walked = own.withColumn("patch", F.explode(F.sequence(F.lit(0), (F.col("h") * F.col("w") - 1).cast("int"))))
    return walked.select("p_partkey", "patch", assets.patch_position(F.col("patch"), F.col("h"), F.col("w"), 2).alias("p")).select("p_partkey", "patch", "p.row", "p.col")
