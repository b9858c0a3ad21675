"""Queries for sinks and sources of results, files, the model connector and the job service, with their DuckDB counterparts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake import engine
from quirelake.functions import assets, geometry, text
from quirelake.operators import blocks, connector, curation, jobs, layout, media, results, scheduling
from quirelake.plans.parity import _BLOCKS, _STATUS, _X, _Y, _job_events, read
from quirelake.session import kept, shared_dir
from quirelake.sources import files

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_RECORD = "image_name string, layouts array<struct<label:string,content:string,page_num:int>>"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_idx, name, record: a result record of every document with all its layouts; names are numbers with leading zeros."""
    found = blocks.formatted(blocks.blocks_of(read(spark, sf_dir, "documents")))
    listed = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "label", "content"))), lambda b: F.struct(b["label"].alias("label"), b["content"].alias("content"), F.lit(1).alias("page_num"))).alias("layouts"))
    name = F.format_string("%06d", F.col("doc_id"))
    return listed.select(F.col("doc_id").alias("doc_idx"), name.alias("name"), F.to_json(F.struct(name.alias("image_name"), "layouts")).alias("record"))


@query(f"with {_BLOCKS} select printf('%06d', doc_id) as name, block_idx as place, label, content from formatted")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records written by name into a bounded number of files, read back, and all their layouts."""
    folder = _folder(spark, "records")
    results.write_records(_records(spark, sf_dir), folder)
    back = results.read_records(spark, folder)
    return back.select("name", F.from_json("record", _RECORD).alias("r")).select("name", F.posexplode("r.layouts").alias("place", "l")).select("name", "place", "l.label", "l.content")


@query(f"""
with {_BLOCKS}, n as (select doc_id, row_number() over (order by doc_id) - 1 as position from documents)
select position, printf('%06d', doc_id) as image_name, count(*) as n_layouts, sha256(string_agg(content, chr(10) order by block_idx)) as contents from formatted join n using (doc_id) group by all
""")
def combined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All result records written as one list in input order and read back with their positions and layouts."""
    folder = _folder(spark, "combined")
    results.write_combined(_records(spark, sf_dir), folder)
    back = results.read_combined(spark, folder, _RECORD)
    return back.select("position", "image_name", F.size("layouts").cast("long").alias("n_layouts"), F.sha2(F.array_join("layouts.content", "\n"), 256).alias("contents"))


@query("""
with c as (select conv_id, count(*) filter (role = 'assistant') as n, count(*) as n_messages, sum(length(text)) filter (role <> 'assistant') as asked from conversations group by conv_id),
l as (select *, row_number() over (order by conv_id) as line, case conv_id % 9 when 1 then 'not a JSON text' when 2 then 'not an object' when 3 then 'no list of messages' else case when n = 0 then 'no answer' end end as error from c)
select line, error, case when error is null then conv_id end as id, case when error is null then 'img' || conv_id || '.png' end as image, case when error is null then n_messages end as n_messages, case when error is null then asked end as asked from l
""")
def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records with ids and images written as one file of JSON lines, some of them broken; read back by line number, with what is wrong with each and what the good ones kept."""
    made = curation.chat_records(read(spark, sf_dir, "conversations"))
    k = F.col("conv_id") % 9
    more = F.concat(F.lit('{"images": ["img'), F.col("conv_id"), F.lit('.png"], "id": '), F.col("conv_id"), F.lit(", "), F.substring("record", 2, 1 << 30))
    value = F.when(k == 1, F.left(more, F.length(more) - 1)).when(k == 2, F.lit("[1, 2]")).when(k == 3, F.lit('{"messages": 3}')).otherwise(more)
    folder = _folder(spark, "chat")
    made.select("conv_id", value.alias("value")).orderBy("conv_id").select("value").coalesce(1).write.text(folder)  # one file, for one numbering of its lines
    judged = curation.checked_records(results.read_lines(spark, folder).select("line", "value"))
    kind = "images array<string>, id long, messages array<struct<role:string,content:string>>"
    parsed = judged.withColumn("r", F.from_json("record", kind))
    asked = F.aggregate(F.filter("r.messages", lambda m: m["role"] != "assistant"), F.lit(0).cast("long"), lambda n, m: n + F.length(m["content"]))
    good = lambda c: F.when(F.col("error").isNull(), c)
    return parsed.select("line", "error", "r.id", F.col("r.images")[0].alias("image"), good(F.size("r.messages").cast("long")).alias("n_messages"), good(asked).alias("asked"))


class _Flaky:
    """Stands in for an endpoint: some questions are answered at the third attempt, some never."""

    def __init__(self):
        self.asked: dict[int, int] = {}

    def __call__(self, url: str, body: bytes, timeout: float) -> tuple[int, bytes]:
        said = json.loads(body)["messages"][0]["content"][-1]["text"]
        k = int(said.rpartition(" ")[2])
        self.asked[k] = self.asked.get(k, 0) + 1
        if k % 11 == 3:
            return 404, b""
        if k % 13 == 5:
            return 429, b""
        if k % 7 == 2:
            return 200, b'{"choices": []}'
        if k % 5 == 0 and self.asked[k] < 3:
            return 503, b""
        return 200, json.dumps({"choices": [{"message": {"content": f"answer to {said}"}}]}).encode()


@query("""
with k as (select o_orderkey as k from orders)
select k as o_orderkey, case when k % 11 = 3 or k % 13 = 5 or k % 7 = 2 then null else 'answer to number ' || k end as raw,
  cast(case when k % 11 = 3 then 1 when k % 13 = 5 then 4 when k % 7 = 2 then 1 when k % 5 = 0 then 3 else 1 end as int) as attempts,
  case when k % 11 = 3 then 'HTTP 404' when k % 13 = 5 then 'HTTP 429' when k % 7 = 2 then 'an answer without a message' end as error from k
""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked of a flaky endpoint: answers in the order of rows, retries, and errors that stay with their rows."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("number "), F.col("o_orderkey").cast("string")).alias("question"))
    return connector.answered(rows, connector.Endpoint("http://model.example/v1", "any", pause=0.0, transport=_Flaky())).select("o_orderkey", "raw", "attempts", "error")


@query("""
with p as (select doc_id as request_id, doc_id % 97 as arrived, cast(unnest(range(0, 1 + n_chars // 3000)) as int) as page_idx from documents)
select request_id, page_idx, page_idx as round, cast(row_number() over (partition by page_idx order by arrived, request_id) - 1 as int) as slot from p
""")
def fair_page_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all requests in the order in which they are read: one page of each request per round."""
    n = F.floor(F.col("n_chars") / 3000).cast("int")
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), (F.col("doc_id") % 97).alias("arrived"), F.explode(F.sequence(F.lit(0), n)).alias("page_idx"))
    return scheduling.fair_rounds(pages).select("request_id", "page_idx", "round", "slot")


@query(f"""
with e as (select user_id as job_id, {_STATUS} as status, ts, event_id from events),
b as (select *, lag(status) over (partition by job_id order by ts, event_id) as before from e)
select before, status, case when before is null then status = 'queued' when before = 'queued' then status in ('processing', 'failed') when before = 'processing' then status in ('extracting', 'succeeded', 'failed') when before = 'extracting' then status in ('succeeded', 'failed') else false end as legal, count(*) as n
from b group by all
""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps between job states, and whether each is one that a job may take."""
    found = scheduling.transitions(_job_events(spark, sf_dir), "job_id", "status", ["ts", "event_id"])
    return found.groupBy("before", "status", "legal").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with l as (select user_id as job_id, max_by({_STATUS}, (ts, event_id)) as status, max(ts) as created_at from events group by user_id)
select job_id, status, status not in ('processing', 'extracting') as deletable from l where job_id % 50 = 7
""")
def session_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs that one session sees, and whether they may be deleted."""
    latest = jobs.latest_status(_job_events(spark, sf_dir), "job_id", "status", ["ts", "event_id"])
    own = latest.select(F.col("job_id").alias("id"), (F.col("job_id") % 50).cast("string").alias("session_id"), "status", F.col("last_event").alias("created_at"))
    return scheduling.visible(own, "7").select(F.col("id").alias("job_id"), "status", scheduling.deletable(F.col("status")).alias("deletable"))


@query()
def admitted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals per kind of event, refused while three accepted ones run."""
    e = read(spark, sf_dir, "events")
    begins = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return scheduling.admitted(e.select("event_type", F.col("event_id").alias("id"), begins.alias("begins"), (begins + F.abs("value") * 60).alias("ends")), "event_type", 3)


@query()
def event_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every user in batches of eight at most that wait six hours at most."""
    e = read(spark, sf_dir, "events")
    return scheduling.micro_batches(e.select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")), "user_id", 8, 6 * 3600.0)


_TOKEN = "abcdefghijklmnopqrstuvwxyz0123456789"


@query(f"""
with h as (select c_custkey, case c_custkey % 6 when 0 then 'Bearer {_TOKEN}' when 1 then 'bEARER {_TOKEN}' when 2 then 'Basic {_TOKEN}' when 3 then 'Bearer  {_TOKEN}' when 4 then 'Bearer' end as header, sha256(c_name) as own from customer)
select c_custkey, c_custkey % 6 in (0, 1) as accepted, true as well_formed from h
""")
def bearer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorization headers with the right and wrong schemes and tokens, and the grammar of tokens."""
    k = F.col("c_custkey") % 6
    token = F.lit(_TOKEN)
    header = F.when(k == 0, F.concat(F.lit("Bearer "), token)).when(k == 1, F.concat(F.lit("bEARER "), token)).when(k == 2, F.concat(F.lit("Basic "), token)).when(k == 3, F.concat(F.lit("Bearer  "), token)).when(k == 4, F.lit("Bearer"))
    return read(spark, sf_dir, "customer").select("c_custkey", scheduling.bearer_accepted(header, _TOKEN).alias("accepted"), scheduling.is_bearer_token(F.sha2("c_name", 256)).alias("well_formed"))


@query("""
select c_custkey, case when count(o_orderkey) = 1 then min('order' || o_orderkey) end as artifact, count(o_orderkey) as found
from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P' group by c_custkey
""")
def single_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one artifact of each workspace (here: the open order of a customer); none where there are several."""
    open_ = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("artifact"))
    return scheduling.the_only(read(spark, sf_dir, "customer").select("c_custkey").join(open_, "c_custkey", "left"), "c_custkey", "artifact")


@query("""
select l_orderkey, case when count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') = 1 then max(l_partkey) filter (l_returnflag = 'R' and l_linestatus = 'F') end as digest from lineitem group by l_orderkey
""")
def platform_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one manifest for a platform among those of an index (an order's lines)."""
    entry = F.struct(F.col("l_partkey").alias("digest"), F.struct(F.col("l_returnflag").alias("os"), F.col("l_linestatus").alias("architecture")).alias("platform"))
    listed = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(entry).alias("m"))
    return listed.select("l_orderkey", scheduling.platform_digest(F.col("m"), "R", "F").alias("digest"))


@query("""
with u as (select conv_id, text, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'user'),
a as (select conv_id, text, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'assistant'),
n as (select conv_id from conversations group by conv_id having count(*) filter (role = 'user') = count(*) filter (role = 'assistant'))
select conv_id, cast(u.k - 1 as int) as at, length(u.text) as asked, length(a.text) as said from u join a using (conv_id, k) where conv_id in (select conv_id from n)
""")
def zipped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers paired by position, for conversations with as many of either."""
    listed = lambda role: F.transform(F.filter(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["role"] == role), lambda x: x["text"])
    both = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(listed("user").alias("u"), listed("assistant").alias("a")).where(F.size("u") == F.size("a"))
    return both.select("conv_id", F.posexplode(results.zipped(F.col("u"), F.col("a"))).alias("at", "p")).select("conv_id", "at", F.length("p.one").cast("long").alias("asked"), F.length("p.two").cast("long").alias("said"))


@query("""
with t as (select conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from conversations where role <> 'system')
select c.conv_id, sha256(coalesce(string_agg(t, chr(10) || chr(10) order by t.turn), '')) as text_sha from (select distinct conv_id from conversations) c left join t on t.conv_id = c.conv_id group by c.conv_id
""")
def response_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a task as one text: those that are missing (here: of the system) left out."""
    said = F.when(F.col("role") != "system", F.concat(F.lit(" "), F.col("text"), F.lit("\n")))
    listed = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]).alias("o"))
    return listed.select("conv_id", F.sha2(results.response_text(F.col("o")), 256).alias("text_sha"))


@query("""
select count(*) filter (l.doc_id is null) as submitted_docs, coalesce(sum(1 + n_chars // 3000) filter (l.doc_id is null), 0)::bigint as submitted_pages, count(l.doc_id) as skipped_docs, round(90.0::double / greatest(1, count(*) filter (l.doc_id is null)), 12) as seconds_per_doc
from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id
""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run of ninety seconds in which labelled documents were skipped."""
    done = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("skipped", F.lit(True))
    docs = read(spark, sf_dir, "documents").join(done, "doc_id", "left").select((1 + F.floor(F.col("n_chars") / 3000)).alias("pages"), F.coalesce("skipped", F.lit(False)).alias("skipped"))
    return results.run_statistics(docs, 90.0).withColumn("seconds_per_doc", F.round("seconds_per_doc", 12))


@query(f"""
with {_BLOCKS},
k as (select doc_id, block_idx, regexp_replace(regexp_replace(raw, '[<>&]', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as t, case when block_idx % 11 = 5 then 'Picture' when block_idx % 11 = 7 then 'Table' when block_idx % 13 = 6 then 'Footnote' else label end as label from blocks)
select doc_id, block_idx, label, sha256(case label when 'Picture' then '![image](../images/doc' || doc_id || '_sub' || (row_number() over (partition by doc_id, label order by block_idx) - 1) || '.jpg)'
  when 'Table' then '<table><tr><td>' || replace(replace(t, '"', '&quot;'), '''', '&#x27;') || '</td><td colspan="2">2</td></tr></table>' when 'Footnote' then '' when 'Title' then '# ' || t when 'Section-header' then '## ' || t else t end) as content_sha from k
""")
def block_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every kind in Markdown, tables as markup and pictures by their numbers among them."""
    at = F.col("block_idx")
    label = F.when(at % 11 == 5, "Picture").when(at % 11 == 7, "Table").when(at % 13 == 6, "Footnote").otherwise(F.col("label"))
    own = blocks.blocks_of(read(spark, sf_dir, "documents")).withColumn("label", label).withColumn("page_idx", F.lit(0))
    plain = text.strip(F.regexp_replace("raw", "[<>&]", " "))
    raw = F.when(F.col("label") == "Table", F.concat(F.lit("<fcel>"), plain, F.lit("<fcel>2<lcel><nl>"))).otherwise(plain)
    full = blocks.formatted_whole(own.withColumn("raw", raw), F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return full.select("doc_id", "block_idx", "label", F.sha2("content", 256).alias("content_sha"))


@query(f"""
with b as (select l_orderkey, l_linenumber, l_quantity * 20 as x1, l_tax * 1000 as y1, l_discount * 10000 as x2, l_quantity + 7 as y2, 600 as w, 800 as h, l_partkey from lineitem)
select l_orderkey, l_linenumber, cast({_X[0]} as int) as x1, cast({_Y[0]} as int) as y1, cast({_X[1]} as int) as x2, cast({_Y[1]} as int) as y2, 'part ' || l_partkey as content from b
""")
def end_to_end_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-page model output with contents, read tolerantly and mapped to pixels; contents come stripped."""
    c = F.col
    own = F.format_string("{'bbox': [%s, %s, %s, %s], 'label': '%d', 'content': '\\n part %d '}", *(x.cast("string") for x in (c("l_quantity") * 20, c("l_tax") * 1000, c("l_discount") * 10000, c("l_quantity") + 7)), c("l_linenumber"), c("l_partkey"))
    listed = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", own.alias("i")))).alias("i"))
    raw = F.concat(F.lit("Here it is: ["), F.array_join(F.transform("i", lambda x: x["i"]), ", "), F.when(c("l_orderkey") % 2 == 0, "]").otherwise(", {'bbox'"))
    found = listed.select("l_orderkey", F.explode(layout.page_items(raw, F.lit(600), F.lit(800))).alias("item"))
    return found.select("l_orderkey", c("item.label").cast("int").alias("l_linenumber"), "item.bbox.*", "item.content")


def _loaded(w: str, h: str, when: str, scale: str) -> str:
    return f"case when {when} then trunc({w} * {scale}) else {w} end as w, case when {when} then trunc({h} * {scale}) else {h} end as h"


@query(f"""
with a as (select p_partkey, (20 + p_size * 40)::double as w, (10 + p_partkey % 3500)::double as h from part),
b as (select p_partkey, {_loaded('w', 'h', 'w * h < 50000', 'sqrt(50000 / (w * h))')} from a),
c as (select p_partkey, {_loaded('w', 'h', 'least(w, h) < 28', '(28 / least(w, h))')} from b),
d as (select p_partkey, w * h > 1003520 as large, w, h from c),
e as (select p_partkey, case when large then trunc(w * sqrt(1003520 / (w * h))) when greatest(w, h) > 3000 then trunc(w * (3000 / greatest(w, h))) else w end as w, case when large then trunc(h * sqrt(1003520 / (w * h))) when greatest(w, h) > 3000 then trunc(h * (3000 / greatest(w, h))) else h end as h from d)
select p_partkey, cast(case when greatest(w, h) > 200 * least(w, h) then 32 else w end as int) as width, cast(case when greatest(w, h) > 200 * least(w, h) then 32 else h end as int) as height from e
""")
def loaded_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes after every loading rule; pixels go before the longer side."""
    own = read(spark, sf_dir, "part").select("p_partkey", (20 + F.col("p_size") * 40).alias("w"), (10 + F.col("p_partkey") % 3500).alias("h"))
    size = media.loaded_size(F.col("w"), F.col("h"), least_pixels=50_000, least_side=28, most_pixels=1_003_520, most_side=3000)
    return own.select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("""
with t as (select doc_id, case doc_id % 3 when 0 then translate(text, 'abcdefgh', chr(1575) || chr(1576) || chr(1578) || chr(1579) || chr(1580) || chr(1581) || chr(1582) || chr(1583)) when 1 then translate(text, 'z', chr(1586)) else text end as t from documents),
c as (select doc_id, length(regexp_replace(t, '[^\\x{0600}-\\x{06FF}]', '', 'g')) as a, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) as n from t)
select doc_id, a > 0 and (n = 0 or a >= 0.2 * n) as arabic from c
""")
def arabic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a fifth of Arabic letters or more; two thirds of all texts are given some or many."""
    t, k = F.col("text"), F.col("doc_id") % 3
    made = F.when(k == 0, F.translate(t, "abcdefgh", "ابتثجحخد")).when(k == 1, F.translate(t, "z", "ز")).otherwise(t)
    return read(spark, sf_dir, "documents").select("doc_id", text.is_arabic(made).alias("arabic"))


@query("""
with p as (select doc_id, n_chars, cast(1 + n_chars // 700 as int) as n from documents where doc_id % 17 <> 4)
select doc_id, n as page_count, cast(unnest(range(0, least(n, 3))) as int) as page_idx, case when n_chars > 15000 then 'UploadTooLargeError' when n > 12 then 'PageLimitExceededError' end as error from p
""")
def pdf_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three pages of PDF files made for documents, every third one updated since, some of them no PDF, and the limit that a file breaks."""
    n = (1 + F.floor(F.col("n_chars") / 700)).cast("int")
    page = lambda number: F.concat(number.cast("string"), F.lit(" 0 obj << /Type /Page /Parent 2 0 R >> endobj\n"))
    tree = F.concat(F.lit("1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Count "), n.cast("string"), F.lit(" >> endobj trailer << /Root 1 0 R >>\n"))
    whole = F.concat(F.array_join(F.transform(F.sequence(F.lit(10), n + 9), page), ""), tree, F.when(F.col("doc_id") % 3 == 0, F.concat(page(F.lit(10)), F.lit("trailer << /Root 1 0 R >>"))).otherwise(""))
    docs = read(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("name"), F.concat(F.when(F.col("doc_id") % 17 == 4, "%PS-").otherwise("%PDF-1.7\n"), whole).cast("binary").alias("content"))
    pages = media.pdf_pages(files, 3).withColumnRenamed("name", "doc_id").join(docs.select("doc_id", "n_chars"), "doc_id")
    return pages.select("doc_id", "page_count", "page_idx", media.upload_error(F.col("n_chars"), F.col("page_count"), 15_000, 12).alias("error"))


@query("""
with s as (select p_partkey, 1 + p_size * 7 as w, 1 + p_partkey % 900 as h, p_partkey % 5 as k from part)
select p_partkey, case k when 0 then 'png' when 1 then 'gif' when 2 then 'jpeg' when 3 then 'jpeg' end as format, cast(case when k = 3 then h when k < 3 then w end as int) as width, cast(case when k = 3 then w when k < 3 then h end as int) as height from s
""")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats and sizes of images in data URIs: PNG, GIF, JPEG upright and turned, and bytes that are none."""
    k = F.col("p_partkey") % 5
    w, h = (1 + F.col("p_size") * 7).cast("int"), (1 + F.col("p_partkey") % 900).cast("int")
    big = lambda x, n: F.lpad(F.hex(x), n, "0")
    little = lambda x: F.concat(F.substring(big(x, 4), 3, 2), F.substring(big(x, 4), 1, 2))
    frame = F.concat(F.lit("FFC0000B08"), big(h, 4), big(w, 4), F.lit("01011100"))
    exif = F.lit("FFE10022457869660000" + "4D4D002A00000008" + "0001" + "011200030000000100060000" + "00000000")
    digits = (
        F.when(k == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 8), big(h, 8)))
        .when(k == 1, F.concat(F.lit("474946383961"), little(w), little(h)))
        .when(k == 2, F.concat(F.lit("FFD8FFE000044A46"), frame))
        .when(k == 3, F.concat(F.lit("FFD8"), exif, frame))
        .otherwise(F.lit("00010203"))
    )
    uri = F.concat(F.lit("data:image/any;base64,"), F.base64(F.unhex(digits)))
    found = read(spark, sf_dir, "part").select("p_partkey", media.image_size(media.data_uri_bytes(uri)).alias("s"))
    return found.select("p_partkey", "s.format", "s.width", "s.height")


@query("""
with recursive c as (select vec_id, cast((i - 1) // 8 as int) as y, cast((i - 1) % 8 as int) as x from (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as v from embeddings) where v > 0),
r(vec_id, y, x, sy, sx) as (select vec_id, y, x, y, x from c union select c.vec_id, c.y, c.x, r.sy, r.sx from r join c on c.vec_id = r.vec_id and abs(c.y - r.y) <= 1 and abs(c.x - r.x) <= 1),
n as (select vec_id, sy, sx, count(*) as n from r group by vec_id, sy, sx)
select e.vec_id, cast(coalesce(max(n.n), 0) as int) as cells from embeddings e left join n on n.vec_id = e.vec_id group by e.vec_id
""")
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest group of positive entries of each vector, read as a mask of eight columns."""
    mask = F.transform("embedding", lambda x: x > 0)
    return read(spark, sf_dir, "embeddings").select("vec_id", media.mask_component(mask, 8).alias("cells"))


@query("""
with p as (select doc_id, cast(unnest(range(0, 1 + n_chars // 3000)) as int) as page_idx from documents)
select doc_id, page_idx, page_idx = 0 and doc_id in (select doc_id from labels) as reused from p
""")
def reused_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose image is in the cache (here: the first page of labelled documents) and is not made again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (1 + F.floor(F.col("n_chars") / 3000)).cast("int").alias("page_count"))
    cache = read(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("page_idx"))
    return files.with_cached_pages(files.pages_of(docs), cache, True).select("doc_id", "page_idx", "reused")


@query("""
select 'doc' || doc_id as name, (1 + n_chars // 3000)::int as page_count, true as is_pdf from documents
""")
def layout_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays with the boxes of all pages of every document; their pages are counted again from the files."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 3000).cast("int"))).alias("page_idx"))
    box = F.struct(F.lit(10).alias("x1"), (F.col("page_idx") * 20).alias("y1"), F.lit(90).alias("x2"), (F.col("page_idx") * 20 + 15).alias("y2"), F.lit("Text (1)").alias("label"))
    made = media.overlays(docs.withColumns({"width": F.lit(600), "height": F.lit(800), "boxes": F.array(box)}))
    return made.select("name", media.pdf_page_count("pdf").alias("page_count"), media.looks_like_pdf(F.col("pdf")).alias("is_pdf"))


@query("""
with p as (select p_partkey, p_size * 1.5::double as w, (p_partkey % 40) * 0.01::double as h, 300 + p_size as sw, 200 + p_partkey % 50 as sh from part)
select p_partkey, cast(greatest(1, floor(w * ((2 * sw + 7) / sw) + 0.5)) as int) as width, cast(greatest(1, floor(h * ((3 * sh + 1) / sh) + 0.5)) as int) as height from p
""")
def crop_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops drawn on shown images in natural pixels; the flattest keep one row of them."""
    shown_w, shown_h = 300 + F.col("p_size"), 200 + F.col("p_partkey") % 50
    size = geometry.cropped_size(F.col("p_size") * 1.5, (F.col("p_partkey") % 40) * 0.01, shown_w, shown_h, 2 * shown_w + 7, 3 * shown_h + 1)
    return read(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("""
with c as (select c_custkey as k, c_custkey % 8 as m from customer)
select k as c_custkey, m in (0, 2, 4) as retryable, m not in (1, 5) as session_ok, m in (0, 3, 6) as truthy, cast(case when m in (2, 7) then k else 1 end as int) as positive,
  case when m = 0 then 'image' when m = 1 then 'pdf' when m = 2 then 'image' else 'unsupported' end as media from c
""")
def service_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses worth another try, session tokens, switches, counts and kinds of files, right and wrong ones of each."""
    k, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 8
    status = F.when(m == 0, 429).when(m == 2, 503).when(m == 4, 500).when(m == 6, 404).otherwise(501)
    token = F.when(m == 1, F.repeat(F.lit("a"), F.lit(31))).when(m == 5, F.concat(F.repeat(F.lit("b"), F.lit(40)), F.lit("!"))).otherwise(F.concat(F.repeat(F.lit("-_z9"), F.lit(8)), k))
    switch = F.when(m == 0, " TRUE ").when(m == 3, "on").when(m == 6, "1").when(m == 7, "y").otherwise("off")
    number = F.when(m.isin(2, 7), F.concat(F.lit(" "), k)).when(m == 1, "0").when(m == 3, "-4").when(m == 5, "many")
    name = F.concat(k, F.when(m == 0, ".JPeG").when(m == 1, ".pdf").when(m == 2, ".TIF").when(m == 3, "").otherwise(".txt"))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", assets.is_retryable(status).alias("retryable"), assets.is_session_token(token).alias("session_ok"), text.truthy(switch).alias("truthy"), F.coalesce(text.positive_int(number), F.lit(1)).alias("positive"), text.media_type(name).alias("media")
    )


@query("""
with c as (select c_custkey as k, c_custkey % 6 as m from customer)
select k as c_custkey, case m when 0 then 'a_b_' || k || '.pdf' when 1 then k || '.png' when 2 then 'upload.bin' when 3 then k || '.bin' when 4 then repeat('n', 128) || '.jpg' else 'hidden' || k || '.bin' end as upload,
  case m when 0 then 'http://host' || k || ':8000' when 1 then 'https://far.example/' || k when 2 then 'http://localhost:1/v1' when 3 then null when 4 then '' else 'http://127.0.0.1/' || k end as address,
  'reg:5000/a/b' || k as image, 'a%20b/' || k || '%3F%C3%BC/' as path from c
""")
def names_and_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of uploads made safe, server addresses, repositories of images, and paths in addresses."""
    k, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 6
    name = F.when(m == 0, F.concat(F.lit("x/a b? "), k, F.lit(".PDF"))).when(m == 1, F.concat(F.lit("up\\y\\"), k, F.lit(".png"))).when(m == 2, "...").when(m == 3, k).when(m == 4, F.concat(F.repeat(F.lit("n"), F.lit(200)), F.lit(".jpg"))).otherwise(F.concat(F.lit(".hidden"), k))
    address = F.when(m == 0, F.concat(F.lit("host"), k, F.lit(":8000//"))).when(m == 1, F.concat(F.lit("https://far.example/"), k)).when(m == 2, "https://localhost:1/v1/").when(m == 3, "ftp://x").when(m == 4, "  ").otherwise(F.concat(F.lit("HTTPS://127.0.0.1/"), k))
    image = F.concat(F.lit("reg:5000/a/b"), k, F.when(m % 3 == 0, ":v1").when(m % 3 == 1, "@sha256:ff").otherwise(":v1@sha256:ff"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.upload_name(name).alias("upload"), text.server_url(address).alias("address"), text.image_repository(image).alias("image"), text.path_segments_encoded(F.concat(F.lit("a b/"), k, F.lit("?ü/"))).alias("path"))


@query("""
with o as (select o_orderkey as k, o_orderkey % 6 as m from orders)
select k as o_orderkey, case m when 0 then null when 1 then 'SUCCESS' when 2 then 'BACKEND_UNAVAILABLE' when 3 then 'GONE' when 4 then 'BACKEND_UNAVAILABLE' else 'BACKEND_UNAVAILABLE' end as code,
  case m when 0 then null when 1 then 'The backend request failed.' when 2 then 'The backend request failed.' when 3 then 'm' || k when 4 then 'The backend is unavailable; retry later.' else 'only words' end as message from o
""")
def upstream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a backend: right ones, lists as data, no JSON, named failures, failures that are masked, failures without a name."""
    k, m = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 6
    status = F.when(m == 3, 404).when(m == 4, 503).when(m == 5, 400).otherwise(200)
    body = (
        F.when(m == 0, F.concat(F.lit('{"internal_code":"SUCCESS","data":{"k":'), k, F.lit("}}")))
        .when(m == 1, F.lit('{"internal_code":"SUCCESS","data":[1]}'))
        .when(m == 2, F.lit("nope"))
        .when(m == 3, F.concat(F.lit('{"internal_code":"GONE","message":"m'), k, F.lit('"}')))
        .when(m == 4, F.lit('{"internal_code":"GONE","message":"secret"}'))
        .otherwise(F.lit('{"message":"only words"}'))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", assets.upstream_error(status, body).alias("e")).select("o_orderkey", "e.code", "e.message")


@query("""
select doc_id, 'see ![p](' || case when doc_id % 3 = 0 then 'data:image/jpeg;base64,' || to_base64(encode('picture ' || doc_id)) else 'img/' || doc_id || '.jpg' end || ') and ![q](https://far.example/' || doc_id || '.png).' as markdown from documents
""")
def inlined_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of Markdown put inside where their file is there (every third); other references stay."""
    i = F.col("doc_id").cast("string")
    own = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see ![p](img/"), i, F.lit(".jpg) and ![q](https://far.example/"), i, F.lit(".png).")).alias("md"))
    there = own.where("doc_id % 3 = 0").select("doc_id", F.create_map(F.concat(F.lit("img/"), i, F.lit(".jpg")), assets.data_uri(F.concat(F.lit("picture "), i).cast("binary"), F.lit("x.jpg"))).alias("files"))
    joined = own.join(there, "doc_id", "left").withColumn("files", F.coalesce("files", F.create_map().cast("map<string,string>")))
    return joined.select("doc_id", assets.inlined(F.col("md"), F.col("files")).alias("markdown"))


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int) as x1, cast(l_quantity as int) + 3 as x2, round(least(0.2 * (l_linenumber + 1), 0.8)::double, 9) as temperature, least(0.5 * pow(2.0, l_linenumber), 30.0)::double as pause from lineitem
""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that were clamped once pass a second clamp unchanged; temperatures and pauses of retries."""
    box = F.struct(F.col("l_quantity").cast("int").alias("x1"), F.lit(0).alias("y1"), (F.col("l_quantity").cast("int") + 3).alias("x2"), F.lit(1).alias("y2"))
    again = geometry.clamp_box(box, F.lit(1000), F.lit(10))
    told = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", again.alias("b"), F.round(text.retry_temperature(F.col("l_linenumber")), 9).alias("temperature"), text.backoff_seconds(0.5, F.col("l_linenumber")).alias("pause"))
    return told.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b.x1", "b.x2", "temperature", "pause")


@query("select doc_id, true as is_request_id, true as is_short, true as is_session_token, 3::bigint as n_own from documents")
def fresh_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and tokens made for every document: their forms, and how many of the three no other document has."""
    made = kept(read(spark, sf_dir, "documents").select("doc_id", assets.new_id().alias("id"), assets.short_id(12).alias("short"), assets.session_token(F.col("doc_id")).alias("token")))
    told = made.select("doc_id", assets.is_request_id(F.col("id")).alias("is_request_id"), F.col("short").rlike("^[0-9a-f]{12}$").alias("is_short"), assets.is_session_token(F.col("token")).alias("is_session_token"), F.explode(F.array("id", "short", "token")).alias("value"))
    alone = told.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return told.join(alone, "value").groupBy("doc_id", "is_request_id", "is_short", "is_session_token").agg(F.count(F.lit(1)).alias("n_own"))


def _told(pages: DataFrame, temperature) -> DataFrame:
    """Stands in for both models: boxes for a page, and what a block says; every fifth document's first answer repeats itself."""
    boxes = "[{'bbox': [0, 10, 500, 90], 'label': 'Title'}, {'bbox': [0, 100, 900, 400], 'label': 'Text'}, {'bbox': [0, 410, 900, 500], 'label': 'Footnote'}, {'bbox': [0, 900, 900, 990], 'label': 'Page-footer'}, {'bbox': [0, 500, 900"
    place = F.concat_ws("/", "doc_id", "page_idx", *(["block_idx"] if "block_idx" in pages.columns else []))
    said = F.when((F.col("doc_id") % 5 == 0) & (F.col("attempt") == 0), F.repeat(F.lit("again "), 30)).otherwise(F.concat(F.lit(" said "), place))
    return pages.withColumn("raw", F.lit(boxes) if "block_idx" not in pages.columns and "label" not in pages.columns else said)


@query("""
with p as (select doc_id, unnest(range(0, 1 + n_chars // 3000)) as page_idx from documents),
m as (select doc_id, page_idx, '# said ' || doc_id || '/' || page_idx || '/0' || chr(10) || chr(10) || 'said ' || doc_id || '/' || page_idx || '/1' as page from p)
select doc_id, 2 * count(*) as n_blocks, sha256(string_agg(page, chr(10) || chr(10) order by page_idx) || chr(10)) as md_sha from m group by doc_id
""")
def pipeline_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the whole pipeline: layout, routing, recognition with retries, formats, assembly."""
    docs = read(spark, sf_dir, "documents").withColumn("page_idx", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 3000).cast("int"))))
    pages = docs.select("doc_id", "page_idx", F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    made = engine.DocumentPipeline(_told, _told).parse(pages)
    return made.select("doc_id", "n_blocks", F.sha2("markdown", 256).alias("md_sha"))
