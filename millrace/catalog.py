"""Queries over the test tables, one for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import chunking, control, history, models, objects, rows, search, select, splitting, vectors, view
from millrace.plans import graph
from millrace.sources import envelopes, paged, parsers, sheets, tables
from millrace.storage import shared_path
from millrace.streaming import pipeline
from millrace.streaming.index import SearchIndex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as changes of users: an error deletes."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return table(spark, sf_dir, "events").select(F.lit("app").alias("source"), F.lit("users").alias("stream"), F.col("user_id").alias("id"), op.alias("operation"), "value", "event_type", F.col("event_id").alias("seq"))


LOG = "select user_id id, case when event_type = 'error' then 'delete' else 'upsert' end op, value, event_type, event_id seq from events"


# Identities


@query("select sha256('db' || chr(31) || 'orders' || chr(31) || o_orderkey::varchar) id, 'upsert' operation, o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') payload_hash from orders")
def envelope_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    payload = C.canonical_json(o_orderkey=F.col("o_orderkey"), o_orderstatus=F.col("o_orderstatus"))
    made = envelopes.envelopes(orders, "db", "orders", F.col("o_orderkey"), payload, metadata=F.create_map(F.lit("key"), F.col("o_orderkey").cast("string")))
    return made.select("id", "operation", F.col("metadata")["key"].cast("long").alias("o_orderkey"), F.sha2("payload", 256).alias("payload_hash"))


@query("""select l_orderkey, l_linenumber, '[{"name":"l_orderkey","type":"bigint","value":"' || l_orderkey || '"},{"name":"l_linenumber","type":"int","value":"' || l_linenumber || '"}]' native_id from lineitem""")
def typed_native_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", C.typed_key(l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber")).alias("native_id"))


@query("""select n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') id from nation""")
def content_hash_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", select.content_id(nation).alias("id"))


@query("""select min(doc_id) doc_id, sha256('{"lang":' || coalesce('"' || lang || '"', 'null') || ',"payload":"' || sha256(text) || '"}') as version, count(*) n from documents group by lang, text""")
def version_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions don't depend on when a document was read."""
    read_at = F.timestamp_seconds(F.col("doc_id"))
    version = C.version_hash(payload=F.sha2("text", 256), lang=F.col("lang"), **{name: read_at for name in sorted(C.VOLATILE)})
    return table(spark, sf_dir, "documents").groupBy(version.alias("version")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("select case when o_orderkey % 7 = 0 then 'id is empty' when o_orderkey % 11 = 0 then 'unknown operation' when o_orderkey % 5 = 0 then 'a delete without a tombstone' end fault, count(*) faults from orders where o_orderkey % 7 = 0 or o_orderkey % 11 = 0 or o_orderkey % 5 = 0 group by 1")
def envelope_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of all orders, of which some are spoilt; the first rule that an envelope breaks counts."""
    key = F.col("metadata")["key"].cast("long")
    made = envelopes.envelopes(table(spark, sf_dir, "orders"), "db", "orders", F.col("o_orderkey"), F.col("o_orderstatus"), metadata=F.create_map(F.lit("key"), F.col("o_orderkey").cast("string")))
    spoilt = made.withColumn("operation", F.when(key % 11 == 0, "move").when(key % 5 == 0, "delete").otherwise(F.col("operation"))).withColumn("id", F.when(key % 7 == 0, "").otherwise(F.col("id")))
    return envelopes.faults(spoilt).groupBy("fault").agg(F.count("*").alias("faults"))


# Current views and changelogs


@query(f"with l as ({LOG}), r as (select *, row_number() over (partition by id order by seq desc) k from l) select id, op operation, value, event_type, seq from r where k = 1 and op <> 'delete'")
def current_view_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.current_view(changelog(spark, sf_dir)).select("id", "operation", "value", "event_type", "seq")


@query(f"with l as ({LOG}), r as (select *, row_number() over (partition by id order by seq desc) k from l) select id, value, event_type, seq from r where k = 1 and op <> 'delete'")
def view_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view in buckets after two batches: all events with other values, then all events."""
    log = changelog(spark, sf_dir)
    kept = pipeline.ViewTable(spark, shared_path(spark, "view"), buckets=16)
    kept.apply(log.withColumn("value", -F.col("value")), 0)
    kept.apply(log, 1)
    return kept.read().select("id", "value", "event_type", "seq")


@query(f"with l as ({LOG}), r as (select id, max_by(op, seq) op from l group by id) select count(*) filter (op = 'delete') removed, count(*) filter (op <> 'delete') present from r")
def current_view_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir)
    keys = log.agg(F.count_distinct("id").alias("n"))
    present = view.current_view(log).agg(F.count("*").alias("present"))
    return keys.join(F.broadcast(present)).select((F.col("n") - F.col("present")).alias("removed"), "present")


@query(f"with l as ({LOG}), s as (select *, case when op <> 'delete' then event_type end state from l), b as (select *, lag(state) over (partition by id order by seq) before from s) select id, count(*) applied from b where state is distinct from before group by id")
def current_view_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.applied(changelog(spark, sf_dir), F.col("event_type")).groupBy("id").agg(F.count("*").alias("applied"))


@query(f"with l as ({LOG}) select id, event_type || ':' || op \"version\", min(seq) seq from l group by all")
def changelog_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir)
    twice = log.unionByName(log.withColumn("seq", F.col("seq") + 1_000_000_000))
    return view.append_changes(twice, F.concat_ws(":", "event_type", "operation")).select("id", "version", "seq")


@query(f"with l as ({LOG}), n as (select id, event_type, op, min(seq) seq from l where (id, event_type) not in (select id, event_type from l where id % 2 = 0) group by all) select id, max_by(event_type, seq) event_type, max(seq) seq from n group by id")
def ledger_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir)
    ledger = log.where("id % 2 = 0").select("id", "event_type", "operation").distinct()
    written, _ = view.ledger_apply(log, ledger, ("id", "event_type", "operation"), ("id",))
    return written.select("id", "event_type", "seq")


@query("select c_custkey, c_name from customer where c_nationkey < 10")
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target whose ledger knows all customers is replaced by those of ten nations: they are written again, the others go."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_nationkey")
    ledger = customer.select(F.lit("customers").alias("target"), F.col("id").alias("event"))
    log = customer.where("c_nationkey < 10").select(F.col("id").alias("event"), "id", "c_name", F.col("id").alias("seq"), F.lit("snapshot").alias("operation"))
    written, _ = view.replaced(log, ledger, "customers", ["event"], ["id"])
    return written.select(F.col("id").alias("c_custkey"), "c_name")


@query(f"with l as ({LOG}), r as (select id, max_by(op, seq) op, max_by(event_type, seq) event_type, max_by(value, seq) value from l group by id) select c_custkey id, 'none' event_type, c_acctbal as value from customer where c_custkey not in (select id from r) union all select id, event_type, value from r where op <> 'delete'")
def merge_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("none").alias("event_type"), F.col("c_acctbal").alias("value"))
    return view.merged_into(target, changelog(spark, sf_dir), ["id"])


@query("select case when target = 0 then 'orders' else 'others' end target, count(*) n from (select o_custkey id, 1 target from orders union all select distinct c_custkey, 0 from customer) group by 1")
def replace_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after the target orders, whose events were all orders, is replaced by customers."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    events = orders.select(F.explode(F.array(F.lit("orders"), F.lit("others"))).alias("target"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("event_hash"))
    fresh = customer.select(F.col("c_custkey").alias("id"), F.xxhash64("c_name").alias("event_hash"), F.lit("snapshot").alias("operation"), F.lit(0).cast("long").alias("seq"))
    _, ledger = view.replaced(fresh, events, "orders", ["id", "event_hash"], ["id"])
    return ledger.groupBy("target").agg(F.count("*").alias("n"))


@query(f"select op operation, count(*) n from ({LOG}) group by op")
def operation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog(spark, sf_dir).groupBy("operation").agg(F.count("*").alias("n"))


@query("select coalesce(a.doc_id, b.doc_id) doc_id, case when a.doc_id is null then 'new' when b.doc_id is null then 'removed' when a.f = b.f then 'unchanged' else 'changed' end change from (select doc_id, sha256(text) f from documents where doc_id % 5 <> 0) a full join (select doc_id, case when doc_id % 7 = 0 then sha256(text || '.') else sha256(text) end f from documents where doc_id % 4 <> 0 or doc_id % 5 = 0) b on a.doc_id = b.doc_id")
def documents_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("f"))
    b = docs.where("doc_id % 4 <> 0 or doc_id % 5 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("f"))
    return view.delta(a, b, "doc_id", "f")


@query("select o_orderkey, unnest(range(o_orderkey % 3, o_orderkey % 7))::bigint element_index, 'delete' operation from orders where o_orderkey % 7 > o_orderkey % 3")
def tombstones_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("parsed"), (F.col("o_orderkey") % 7).alias("committed"))
    return view.tombstones(counts, "o_orderkey", "committed", "parsed")


# Sources


def event_lines(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    """events in order as files of JSON lines, read as envelopes."""
    path = shared_path(spark, "jsonl")
    props = F.concat(F.substring("props", 1, F.length("props") - 1), F.lit(', "event": '), F.col("event_id").cast("string"), F.lit("}"))
    head = F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"id": '), key.cast("string"), F.lit(", ")), F.lit("")))
    line = F.concat(head, F.lit('"props": '), props, F.lit("}"))
    table(spark, sf_dir, "events").repartitionByRange("event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    return envelopes.json_lines(spark, path, "files", "events")


@query("select event_id, json_extract_string(props, '$.k')::bigint k from events")
def jsonl_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_lines(spark, sf_dir, F.col("event_id"))
    body = F.try_parse_json("payload")
    return rows.select(F.variant_get(body, "$.id", "long").alias("event_id"), F.variant_get(body, "$.props.k", "long").alias("k"))


@query("select event_id, row_number() over (order by event_id) - 1 seq from events")
def jsonl_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without ids, by their places."""
    return event_lines(spark, sf_dir, F.lit(None)).select(F.variant_get(F.try_parse_json("payload"), "$.props.event", "long").alias("event_id"), "seq")


@query("""with c as (select c_nationkey t, row_number() over (partition by c_nationkey order by c_custkey) - 1 i, c_name, c_custkey, c_acctbal from customer)
    select t::varchar table_id, (i // 500)::int batch, (i + 2)::int as row, c_name as name, case when c_acctbal >= 0 then c_custkey::varchar end number from c""")
def table_artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognised table for each nation: two rows of headers, the upper cell over both columns, then its customers; those in debt have no second cell."""
    customer = table(spark, sf_dir, "customer").withColumn("row", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) + 1)
    name = F.col("c_nationkey").cast("string").alias("table_id")
    cell = lambda row, column, text, wide=1, level=None: F.struct(row.cast("int").alias("row"), F.lit(column).alias("column"), F.lit(1).alias("rowspan"), F.lit(wide).alias("colspan"), F.lit(level).cast("int").alias("header_level"), text.alias("text"))
    heads = F.array(cell(F.lit(0), 0, F.lit("Customer"), 2, 0), cell(F.lit(1), 0, F.lit("Name"), 1, 1), cell(F.lit(1), 1, F.lit(" Number "), 1, 1))
    body = F.filter(F.array(cell(F.col("row"), 0, F.col("c_name")), F.when(F.col("c_acctbal") >= 0, cell(F.col("row"), 1, F.col("c_custkey").cast("string")))), lambda c: c.isNotNull())
    cells = customer.select(name, F.explode(body).alias("c")).unionByName(customer.select(name).distinct().select("table_id", F.explode(heads).alias("c")))
    cells = cells.select("table_id", "c.*", F.lit(None).cast("string").alias("value"))
    sizes = customer.groupBy(name).agg((F.max("row") + 1).cast("int").alias("row_count"), F.lit(2).alias("column_count"))
    rows = tables.table_rows(sizes, cells)
    return rows.select("table_id", "batch", "row", F.col("values")["Customer / Name"].alias("name"), F.col("values")["Customer / Number"].alias("number"))


@query("""select (c_custkey // 1000)::varchar path, 'Customers' as "table", ((row_number() over (partition by c_custkey // 1000 order by c_custkey) - 1) // 500)::int batch, c_custkey number, c_name as name, c_acctbal >= 0 solvent from customer""")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for every thousand customers, read back in batches."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("<row><c><v>"), "c_custkey", F.lit('</v></c><c t="inlineStr"><is><t>'), "c_name", F.lit('</t></is></c><c t="b"><v>'), (F.col("c_acctbal") >= 0).cast("int"), F.lit("</v></c></row>")).alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "row"))), lambda r: r["row"]), "")
    book = F.pandas_udf(lambda s: s.map(lambda rows: sheets.workbook("Customers", ["number", "name", "solvent"], rows)), "binary")
    made = customer.groupBy(F.floor(F.col("c_custkey") / 1000).cast("string").alias("path")).agg(body.alias("rows")).select("path", F.lit("xlsx").alias("extension"), book("rows").alias("content"))
    batches, _ = sheets.table_batches(made)
    row = F.from_json("row", "number long, name string, solvent boolean")
    return batches.select("path", "table", "batch", F.explode("rows").alias("row")).select("path", "table", "batch", row.alias("row")).select("path", "table", "batch", "row.*")


@query("select doc_id, (i // 450)::int as \"index\", 'text' element_type, sha256(substring(text, i + 1, 500)) part from (select doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 450)) i from documents)")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A splitter as a table function in SQL."""
    splitting.register(spark, "split_windows", splitting.windows(500, 50))
    return spark.sql("select doc_id, part.index, part.element_type, sha2(part.text, 256) part from {docs}, lateral split_windows(text) part", docs=table(spark, sf_dir, "documents"))


@query("with p as (select 'k' path, json_extract(props, '$.k') v from events) select path, case when json_type(v) in ('BIGINT', 'UBIGINT') then 'integer' when json_type(v) = 'DOUBLE' then 'number' when json_type(v) = 'VARCHAR' then 'string' else lower(json_type(v)) end as type, count(*) \"rows\" from p where v is not null group by all")
def schema_infer_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged.path_types(table(spark, sf_dir, "events"), "props")


@query("select c_custkey, c_name from customer where c_custkey > 700 order by c_custkey limit 100")
def keyset_snapshot_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], [700], 100)


@query("select o_orderdate, o_orderkey from orders where (o_orderdate, o_orderkey) > (timestamp '1995-06-01', 500) order by 1, 2 limit 200")
def keyset_incremental_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    return select.page(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], [datetime(1995, 6, 1), 500], 200)


def passed(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = [n for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if f"{{{n}}}" in text]
    return select.select(spark, text, {n: table(spark, sf_dir, n) for n in names})


def passthrough(name: str, text: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return passed(spark, sf_dir, text)

    run.__name__ = name
    query(sql or text.replace("{", "").replace("}", ""))(run)


passthrough("select_passthrough_join_agg", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey WHERE l_shipdate >= timestamp '1995-01-01' GROUP BY n_name")
passthrough("select_passthrough_window", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM {orders}")
passthrough("select_passthrough_setops", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM {supplier} EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1 UNION ALL SELECT r_regionkey FROM {region}")
passthrough("select_passthrough_semi_anti", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
passthrough("select_passthrough_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
passthrough("select_passthrough_outer", "SELECT n_name, count(s_suppkey) AS suppliers, count(DISTINCT s_acctbal) AS balances FROM {nation} LEFT JOIN {supplier} ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY n_name")
passthrough("select_passthrough_lateral", "SELECT n_name, c_name, c_acctbal FROM {nation}, LATERAL (SELECT c_name, c_acctbal FROM {customer} WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) AS t")


@query("select l_orderkey, l_linenumber from lineitem order by 1, 2 limit 1000")
def bounded_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select(spark, "SELECT l_orderkey, l_linenumber FROM {lineitem} ORDER BY 1, 2", {"lineitem": table(spark, sf_dir, "lineitem")}, 1000)


# Rows

CONDITION = "item['n_chars'] > 1000 and item['lang'] in ['en', 'de'] or item.source.startswith('src1')"


@query("select doc_id from documents where n_chars > 1000 and lang in ('en', 'de') or starts_with(source, 'src1')")
def filter_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.filter_rows(table(spark, sf_dir, "documents"), CONDITION)[0].select("doc_id")


@query("select doc_id from documents where not coalesce(n_chars > 1000 and lang in ('en', 'de') or starts_with(source, 'src1'), false)")
def filter_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.filter_rows(table(spark, sf_dir, "documents"), CONDITION)[1].select("doc_id")


@query("select event_id from events where case when try_cast(event_type as bigint) is null then true else not (try_cast(event_type as bigint) >= 0 or user_id % 3 = 0) end")
def filter_error_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.filter_rows(table(spark, sf_dir, "events"), "int(item['event_type']) >= 0 or item['user_id'] % 3 == 0")[1].select("event_id")


@query("select c_custkey, upper(c_name) as name, round(c_acctbal * 2, 2) as doubled, case when c_acctbal > 0 then 'credit' else 'debt' end as side, length(c_mktsegment) as size from customer")
def transform_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.transform_rows(table(spark, sf_dir, "customer"), c_custkey="item['c_custkey']", name="item.c_name.upper()", doubled="round(item['c_acctbal'] * 2, 2)", side="'credit' if item['c_acctbal'] > 0 else 'debt'", size="len(item['c_mktsegment'])")


@query("select s_suppkey, 'Supplier ' || s_name || ' of nation ' || s_nationkey || '.' as line from supplier")
def transform_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    return suppliers.select("s_suppkey", C.template("Supplier {{ s_name }} of nation {{s_nationkey}}.", {c: F.col(c) for c in suppliers.columns}).alias("line"))


@query("with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 i from orders) select i // 64 as batch, count(*) n, min(o_orderkey) first_key, max(o_orderkey) last_key from o group by 1")
def split_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows.split_batches(table(spark, sf_dir, "orders").select("o_orderkey"), 64, ["o_orderkey"])
    return found.select("batch", "n", F.array_min("items.o_orderkey").alias("first_key"), F.array_max("items.o_orderkey").alias("last_key"))


@query("select c_custkey as k, c_name as name, 0 as input from customer union all select s_suppkey, s_name, 1 from supplier")
def merge_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return rows.merge_concat(a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("select l_orderkey as k, row_number() over (order by l_orderkey, l_linenumber) - 1 as ordinal, 0 as input from lineitem union all select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1, 1 from orders")
def merge_concat_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    return rows.merge_concat(a, b, orders=(["k", "l_linenumber"], ["o_orderdate", "k"])).select("k", "ordinal", "input")


@query("with a as (select c_name, row_number() over (order by c_custkey) - 1 idx from customer), b as (select s_name, row_number() over (order by s_suppkey) - 1 idx from supplier) select idx, c_name, s_name from a join b using (idx)")
def merge_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return rows.merge_zip(a, b, ["c_custkey"], ["s_suppkey"]).select("idx", "c_name", "s_name")


@query("""with l as (select user_id, max(event_id) filter (event_type = 'error') e, max(event_id) m from events group by 1),
    t as (select l.user_id, event_type, max(event_id) x from events v join l on v.user_id = l.user_id where event_type <> 'error' and (e is null or event_id > e) group by 1, 2),
    g as (select user_id, string_agg('"' || event_type || '": ' || x, ', ' order by event_type) s from t group by 1)
    select l.user_id, '{"by": ' || coalesce('{' || s || '}', 'null') || ', "last": ' || m || '}' merged from l left join g on g.user_id = l.user_id""")
def merge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as objects: each writes its number under its kind, an error writes null over all kinds."""
    n = F.col("event_id").cast("string")
    by = F.when(F.col("event_type") == "error", "null").otherwise(F.concat(F.lit('{"'), "event_type", F.lit('": '), n, F.lit("}")))
    body = F.concat(F.lit('{"by": '), by, F.lit(', "last": '), n, F.lit("}"))
    return objects.merge_json(table(spark, sf_dir, "events").select("user_id", "event_id", body.alias("body")), "user_id", "event_id", "body")


@query("with a as (select c_custkey k, c_name name, c_acctbal balance from customer where c_custkey % 2 = 0), b as (select c_custkey k, case when c_custkey % 3 = 0 then upper(c_name) end name, c_nationkey nation from customer) select coalesce(a.k, b.k) k, coalesce(b.name, a.name) name, a.balance, b.nation from a full join b on a.k = b.k")
def merge_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    a = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance")).alias("info"))
    b = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("info"))
    return rows.merge_objects(a, b, key="k").select("k", "name", F.col("info.balance").alias("balance"), F.col("info.nation").alias("nation"))


@query("select doc_id, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as text from documents order by doc_id limit 10")
def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.preview(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])


# Chunks

WORDS = r"list_filter(regexp_split_to_array(text, '[\s\x0B\x{85}\x{A0}\p{Z}]+'), lambda x: x <> '')"


@query(rf"with d as (select doc_id, {WORDS} w from documents), c as (select doc_id, w, unnest(range(0, len(w), 462)) i from d), n as (select doc_id, i // 462 as local, array_to_string(w[i + 1:i + 512], ' ') as text, len(w[i + 1:i + 512]) as chunk_tokens from c) select *, row_number() over (order by doc_id, local) - 1 as chunk_index from n")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_index(chunking.chunk_tokens(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


@query("with c as (select doc_id, text, unnest(range(0, length(text), 900)) i from documents where trim(text) <> '') select doc_id, i // 900 as local, sha256(substring(text, i + 1, 1000)) as text, length(substring(text, i + 1, 1000)) as chunk_tokens from c")
def chunk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_tokens(table(spark, sf_dir, "documents"), "doc_id", size=1000, overlap=100, unit="chars").withColumn("text", F.sha2("text", 256))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_recursive(table(spark, sf_dir, "documents"), "doc_id")


@query()
def chunk_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_html(table(spark, sf_dir, "pages"), "page_id").withColumn("tag_hierarchy", F.array_join("tag_hierarchy", "/"))


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_semantic(table(spark, sf_dir, "documents"), "doc_id", chunking.hash_embedding)


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_elements(table(spark, sf_dir, "documents"), "doc_id")


@query()
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", parsers.html_text_column(F.col("html"), stripped=True).alias("text"))


@query(r"select doc_id, len(list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) sentences from documents")
def sentences_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(C.sentences(F.col("text"))).alias("sentences"))


@query(r"with v as (select doc_id, regexp_replace(text, '[\s\x0B\x{85}\x{A0}\p{Z}]', '', 'g') t from documents), n as (select doc_id, length(t) n, length(t) - length(regexp_replace(t, '[\x{FFFD}\x{0}]', '', 'g')) w, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) a from v) select doc_id, round(case when n = 0 then 0 else greatest(0, least(1, least(n / 200.0, 1.0)::double * 0.65 + a / n * 0.35 - w / n)) end, 9) quality from n")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(C.text_quality(F.col("text")), 9).alias("quality"))


@query("select doc_id, greatest(1, length(text) // 3000)::int page_count from documents")
def txt_pagecount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.page_count(F.col("text")).alias("page_count"))


@query("select (p_partkey // 1000)::varchar part, greatest(1, count(*) // 50)::int page_count, count(*) - 1 breaks from part group by 1")
def csv_text_pagecount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file for every thousand parts, parsed."""
    line = F.concat_ws(",", "p_partkey", "p_brand", "p_size")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda r: r["line"]), "\n")
    made = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 1000).cast("string").alias("name")).agg(F.encode(lines, "UTF-8").alias("content"))
    good, _ = parsers.parse_files(made.select(F.concat("name", F.lit(".csv")).alias("path"), "name", F.lit("csv").alias("extension"), F.length("content").cast("long").alias("size"), "content"))
    return good.select(F.col("name").alias("part"), "page_count", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("breaks"))


@query("with b as (select p_partkey, coalesce(nullif(trim(case when p_partkey % 5 = 0 then ' ' else p_brand end), ''), 'column_' || row_number() over (order by p_partkey)) base from part), n as (select *, row_number() over (partition by base order by p_partkey) k from b) select p_partkey, case when k = 1 then base else base || '_' || k end as name from n")
def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = rows.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"])
    cell = F.trim(F.when(F.col("p_partkey") % 5 == 0, F.lit(" ")).otherwise(F.col("p_brand")))
    base = placed.withColumn("base", F.when(cell == "", F.concat(F.lit("column_"), F.col("idx") + 1)).otherwise(cell))
    k = F.row_number().over(W.partitionBy("base").orderBy("idx"))
    return base.select("p_partkey", F.when(k == 1, F.col("base")).otherwise(F.concat_ws("_", "base", k)).alias("name"))


# Vectors and models


@query("with q as (select embedding e from embeddings where vec_id = 0) select vec_id, round(list_dot_product(embedding::double[], q.e::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q.e::double[], q.e::double[]))), 6) similarity from embeddings, q order by 2 desc, 1 limit 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()
    return models.cosine_top(vectors, first["embedding"], 10, "vec_id")


NEAREST = """with v as (select vec_id, embedding::double[] e from embeddings), p as (select a.vec_id query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) similarity from v a, v b where a.vec_id % 50 = 0),
    r as (select *, (row_number() over (partition by query_id order by similarity desc, vec_id))::int rank from p) select query_id, rank, vec_id, round(similarity, 6) similarity from r where rank <= 10"""


@query(NEAREST)
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 50, against all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = vectors.VectorIndex(shared_path(spark, "vectors"), "vec_id").build(rows, 64)
    return index.search_exact(rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10).withColumn("similarity", F.round("similarity", 6))


@query("select count(*) wrong from embeddings where embedding is null or len(embedding) <> 64")
def vector_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.wrong_dimensions(table(spark, sf_dir, "embeddings"), 64).agg(F.count("*").alias("wrong"))


@query("with b as (select label, vec_id, embedding::double[] a, lag(embedding::double[]) over (partition by label order by vec_id) b from embeddings) select label, vec_id, case when b is not null then round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) end similarity from b")
def neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.neighbours(table(spark, sf_dir, "embeddings"), "label", "vec_id")


@query("select event_id, event_type category, greatest(0, least(1, value / 100)) confidence, event_type in ('click', 'view') expected, true success from events where event_id % 3 <> 2 union all select event_id, null, null, false, false from events where event_id % 3 = 2")
def llm_parse_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"category": "'), F.col("event_type"), F.lit('", "confidence": '), (F.col("value") / 100).cast("string"), F.lit("}"))
    response = F.when(F.col("event_id") % 3 == 0, body).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).otherwise(F.lit("no idea"))
    rows_ = table(spark, sf_dir, "events").select("event_id", response.alias("response"))
    return models.classification(rows_, "response", ["click", "view"]).drop("response")


@query("with p(model, a, b) as (values ('click', 0.5, 1.5), ('view', 2.0, 6.0)) select event_type model, round(sum(round(round(user_id / 1e6 * coalesce(a, 0), 10) + round(event_id / 1e6 * coalesce(b, 0), 10), 10)), 6) as cost from events left join p on p.model = event_type group by 1")
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 0.5, 1.5), ("view", 2.0, 6.0)], "model string, prompt_price double, completion_price double")
    usage = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("prompt_tokens"), F.col("event_id").alias("completion_tokens"))
    return models.costs(usage, prices).groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"))


# Search

BM25 = r"""with d as (select doc_id, source, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda t: t <> '') w from documents),
    f as (select doc_id, source, len(w) n, len(list_filter(w, lambda t: t = 'the')) a, len(list_filter(w, lambda t: t = 'thing')) b from d),
    s as (select count(*) n, avg(n) l, count(*) filter (a > 0) da, count(*) filter (b > 0) db from f),
    i as (select *, case when ln((n - da + 0.5) / (da + 0.5)) <= 0 then 1e-6 else ln((n - da + 0.5) / (da + 0.5)) end ia, case when ln((n - db + 0.5) / (db + 0.5)) <= 0 then 1e-6 else ln((n - db + 0.5) / (db + 0.5)) end ib from s),
    r as (select doc_id, source, round(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * f.n / l)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * f.n / l)), 9) score from f, i where a > 0 and b > 0)"""


def found(spark: SparkSession, sf_dir: str, **request) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return search.search(docs, search.Request(**request), seq="doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query(f"{BM25} select doc_id, score from r order by score desc, doc_id limit 10")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, text="the, THING!")


@query(f"{BM25} select doc_id, score from r where source = 'src3' order by score desc, doc_id limit 5 offset 2")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, text="the thing", limit=5, offset=2, where=(("source", "src3"),))


@query("select doc_id, 0.0::double score from documents order by doc_id desc limit 20 offset 5")
def search_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, limit=20, offset=5)


@query(f"{BM25} select count(*) total from r")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.total(table(spark, sf_dir, "documents"), search.Request("the thing"))


def indexed(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """All documents in an index, by two batches: the first has another text of each and a row more for each, the second replaces the texts and deletes those rows."""
    docs = table(spark, sf_dir, "documents").select(F.lit("files").alias("stream"), "doc_id", "source", "text", "lang")
    typed = docs.select("source", "stream", F.col("doc_id").cast("string").alias("id"), F.lit("upsert").alias("operation"), "text", F.col("doc_id").alias("seq"), "doc_id", "lang")
    again = typed.withColumn("id", F.concat(F.lit("draft "), "id"))
    first = typed.withColumn("text", F.concat_ws(" ", F.lit("the thing of the"), "lang"))
    index = SearchIndex(spark, shared_path(spark, "index"), stored=("doc_id",))
    index.apply(first.unionByName(again), 0)
    index.apply(typed.unionByName(again.withColumn("operation", F.lit("delete"))), 1)
    return index


def hits(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.round("score", 9).alias("score"))


@query(f"{BM25} select doc_id, score from r where source = 'src3' order by score desc, doc_id limit 5 offset 2")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(indexed(spark, sf_dir).search(search.Request("the, THING!", limit=5, offset=2, where=(("source", "src3"),))))


@query(r"""with d as (select doc_id, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda t: t <> '') w from documents),
    f as (select doc_id, len(w) n, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) a from d),
    s as (select count(*) c, avg(n) l, count(*) filter (a > 0) da from f)
    select doc_id, round(case when ln((c - da + 0.5) / (da + 0.5)) <= 0 then 1e-6 else ln((c - da + 0.5) / (da + 0.5)) end * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / l)), 9) score
    from f, s where a > 0 order by score desc, doc_id limit 100""")
def index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(indexed(spark, sf_dir).search(search.Request("of_the", limit=100)))


@query(f"{BM25} select count(*) total from r")
def index_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the segments were made one."""
    index = indexed(spark, sf_dir)
    index.compact()
    return index.total(search.Request("the thing"))


@query("select event_id, event_type || ' ' || json_extract_string(props, '$.k') || ' end' as text from events")
def searchable_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"kind": "record", "a": ["'), F.col("event_type"), F.lit('", '), F.col("props"), F.lit(', true, null, {"provenance": 1, "z": "end"}]}'))
    return table(spark, sf_dir, "events").select("event_id", search.searchable_text(body).alias("text"))


# Control


@query("select user_id, event_type, min(event_id) event_id from events group by all")
def webhook_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.streaming.state import first_deliveries

    return first_deliveries(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


@query("""with recursive e as (select event_id, event_type trigger, ts, row_number() over (partition by event_type order by ts, event_id) i from events),
    r as (select trigger, 0::bigint i, null::bigint event_id, []::timestamp[] held, false accepted from (select distinct trigger from e)
          union all
          select e.trigger, e.i, e.event_id, case when len(h) < 2 then list_append(h, ts) else h end, len(h) < 2
          from (select r.trigger, e.i, e.event_id, e.ts, list_filter(held, lambda x: x >= e.ts - interval 60 second) h from r join e on e.trigger = r.trigger and e.i = r.i + 1) e)
    select event_id, trigger, accepted from r where i > 0""")
def rate_limit_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    deliveries = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("trigger"), "ts")
    return control.accept_deliveries(deliveries, "trigger", "ts", "event_id", 2).select("event_id", "trigger", "accepted")


@query("select o_orderkey, case when epoch(timestamp '1996-01-01') < epoch(o_orderdate) then o_orderdate else o_orderdate + to_seconds((floor((epoch(timestamp '1996-01-01') - epoch(o_orderdate)) / 86400) + 1) * 86400) end as next_run from orders")
def schedule_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    at = C.next_interval(F.col("o_orderdate").cast("timestamp"), F.lit("1996-01-01").cast("timestamp"), 86_400)
    return orders.select("o_orderkey", at.cast("timestamp_ntz").alias("next_run"))


JOBS = "select o_orderkey job_id, case when o_orderkey % 3 = 0 then 'leased' when o_orderkey % 3 = 1 then 'queued' else 'done' end status, o_orderdate available_at, o_orderdate created_at, o_orderdate + interval 1 day lease_expires_at from orders"


@query(f"with j as ({JOBS}) select job_id, status from j where status = 'queued' and available_at <= timestamp '1996-01-01' or status = 'leased' and lease_expires_at <= timestamp '1996-01-01' order by available_at, created_at, job_id limit 5")
def lease_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(k.alias("job_id"), F.when(k % 3 == 0, "leased").when(k % 3 == 1, "queued").otherwise("done").alias("status"), F.col("o_orderdate").alias("available_at"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("lease_expires_at"))
    return control.claimable(jobs, F.lit("1996-01-01").cast("timestamp_ntz"), 5).select("job_id", "status")


@query("select o_custkey node, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) state from orders group by 1")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("state"), "o_orderdate")
    return view.latest(saved, ["node"], ["o_orderdate", "state"]).select("node", "state")


EDGES = "select s_suppkey source, s_suppkey * 2 target from supplier union all select s_suppkey, s_suppkey * 3 from supplier where s_suppkey % 2 = 1"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(key.alias("source"), (key * 2).alias("target")).unionByName(s.where(key % 2 == 1).select(key.alias("source"), (key * 3).alias("target"))).where("source > 0")


@query(f"with recursive e as (select * from ({EDGES}) where source > 0), r as (select 1::bigint node union select 5 union select target from e join r on e.source = r.node) select node from r")
def failed_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.downstream(edges(spark, sf_dir), spark.createDataFrame([(1,), (5,)], "node long"))


@query(f"with recursive e as (select * from ({EDGES}) where source > 0), v as (select source node from e union select target from e), r as (select node, 0 level from v union select target, level + 1 from e join r on e.source = r.node) select node, max(level) as level from r group by node")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.table_levels(e, e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct())


@query("select 'orders' source_node, 'sink' target_node, count(*) items_count, sum(length('{\"o_orderkey\":' || o_orderkey || '}')) approx_bytes from orders")
def lineage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.lineage(table(spark, sf_dir, "orders").select("o_orderkey"), "orders", "sink").drop("sample")


@query("""select 'parse' node, 'negative balance' error, '{"c_custkey":' || c_custkey || '}' input_data, 0 retry_count, false resolved from customer where c_acctbal < 0 order by c_custkey limit 20""")
def dlq_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    _, bad = control.rejected(c.orderBy("c_custkey").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0, "parse", F.lit("negative balance"))
    key = F.get_json_object("input_data", "$.c_custkey")
    return bad.orderBy(key.cast("long")).limit(20).withColumn("input_data", F.concat(F.lit('{"c_custkey":'), key, F.lit("}")))


@query("select o_orderkey, c_name, count(*) over () total from orders join customer on o_custkey = c_custkey where c_nationkey = 3 order by o_orderdate desc, o_orderkey limit 20 offset 20")
def run_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey"))
    total = mine.agg(F.count("*").alias("total"))
    return mine.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(20).limit(20).select("o_orderkey", "c_name").join(F.broadcast(total))


@query("select o_orderstatus, o_orderpriority, (o_orderstatus = 'O' and o_orderpriority = '1-URGENT') allowed, count(*) n from orders group by all")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus", "o_orderpriority", control.may_follow(F.col("o_orderstatus"), F.col("o_orderpriority"), {"O": ("1-URGENT",)}).alias("allowed")).agg(F.count("*").alias("n"))


# History


def histories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries of runs, runs of graphs, and graphs of owners: orders, customers and nations."""
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), "o_orderkey", F.col("o_orderpriority").alias("source_ref"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("graph_id"))
    return entries, runs, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("graph_id"), F.col("n_regionkey").alias("owner_id"))


@query("select o_custkey run_id, o_orderdate created_at, o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3) order by 2 desc, 1, 3 limit 100")
def lineage_of_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, runs, _ = histories(spark, sf_dir)
    return history.lineage_of_graph(entries.drop("source_ref"), runs, 3)


@query("select o_custkey run_id, o_orderkey, s_suppkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join supplier on s_suppkey = o_custkey where o_orderpriority = '1-URGENT' and n_regionkey = 1")
def lineage_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, runs, graphs = histories(spark, sf_dir)
    lineage = table(spark, sf_dir, "supplier").withColumn("run_id", F.col("s_suppkey"))
    found = history.lineage_of_source(entries, lineage, "1-URGENT", runs, graphs, 1)
    return found.select("run_id", F.col("provenance.o_orderkey").alias("o_orderkey"), F.col("lineage.s_suppkey").alias("s_suppkey"))


@query("select o_orderkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = 2")
def dead_letters_of_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.owned(*histories(spark, sf_dir), 2).select("o_orderkey")


@query("select c_custkey, coalesce(max(o_orderkey), 0) + 1 \"version\" from customer left join orders on o_custkey = c_custkey group by 1")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("version"))
    return history.next_versions(saved, table(spark, sf_dir, "customer"), "c_custkey")


@query("select p_brand as \"owner\", sum(p_partkey)::bigint used from part group by 1")
def storage_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.storage_used(table(spark, sf_dir, "part"), "p_brand", "p_partkey").withColumnRenamed("p_brand", "owner")


@query("select p_partkey from part order by coalesce(case when p_partkey % 7 > 0 then p_partkey / 10.0 end, 999.0), p_partkey limit 50")
def models_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 > 0, F.col("p_partkey") / 10).alias("price"))
    return history.by_price(part, "price", "p_partkey").limit(50).select("p_partkey")


@query("select c_mktsegment as source, c_nationkey stream from customer except select c_mktsegment, c_nationkey from customer where c_acctbal > 9000")
def deselected_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("source"), F.col("c_nationkey").alias("stream"), "c_acctbal")
    return history.deselected(before, before.where("c_acctbal > 9000"))


@query("select n_nationkey as \"index\", 'c1,c0' names from nation where n_nationkey <> 1 and n_nationkey % 3 = 1")
def unique_index_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    indexes = table(spark, sf_dir, "nation").select(key.alias("index"), (key != 1).alias("is_unique"), F.sequence((key % 3).cast("long"), F.lit(0).cast("long")).alias("positions"))
    columns = table(spark, sf_dir, "nation").select(key.cast("long").alias("position"), F.concat(F.lit("c"), key).alias("name"))
    return history.unique_key(indexes, columns, ["c0", "c1"]).select("index", F.array_join("names", ",").alias("names"))


# Windows over event time (an extension)


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def event_windows_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pipeline.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", "event_type", n=F.count("*"), total=F.round(F.sum("value"), 4))
    return made.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("select time_bucket(interval 30 minute, ts) - to_minutes(30 * k) as start, count(*) n from events, (select unnest([0, 1]) k) group by 1")
def event_windows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pipeline.sliding(table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", n=F.count("*"))
    return made.select(F.col("window.start").alias("start"), "n")


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, min(ts) as start, count(*) n from s group by user_id, k")
def event_windows_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pipeline.sessions(table(spark, sf_dir, "events"), "ts", "12 hours", "user_id", n=F.count("*"))
    return made.select("user_id", F.col("session_window.start").alias("start"), "n")


# All together


@query(r"""with d as (select doc_id, list_filter(regexp_split_to_array(text, '[\s\x0B\x{85}\x{A0}\p{Z}]+'), lambda x: x <> '') w from documents),
    c as (select sha256('corpus' || chr(31) || 'chunks' || chr(31) || doc_id || ':' || (i // 462)) id, array_to_string(w[i + 1:i + 512], ' ') t from (select doc_id, w, unnest(range(0, len(w), 462)) i from d)),
    k as (select id, list_filter(regexp_split_to_array(lower(strip_accents(t)), '[^\p{L}\p{N}]+'), lambda t: t <> '') w from c),
    f as (select id, len(w) n, len(list_filter(w, lambda t: t = 'and')) a, len(list_filter(w, lambda t: t = 'with')) b from k),
    s as (select count(*) n, avg(n) l, count(*) filter (a > 0) da, count(*) filter (b > 0) db from f),
    i as (select *, case when ln((n - da + 0.5) / (da + 0.5)) <= 0 then 1e-6 else ln((n - da + 0.5) / (da + 0.5)) end ia, case when ln((n - db + 0.5) / (db + 0.5)) <= 0 then 1e-6 else ln((n - db + 0.5) / (db + 0.5)) end ib from s)
    select id, round(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * f.n / l)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * f.n / l)), 9) score from f, i where a > 0 and b > 0 order by score desc, id limit 10""")
def ingest_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents to chunks, chunks to envelopes, envelopes to a current view, the view searched."""
    chunks = chunking.chunk_tokens(table(spark, sf_dir, "documents"), "doc_id").withColumn("seq", F.col("local").cast("long"))
    made = envelopes.envelopes(chunks, "corpus", "chunks", F.concat_ws(":", "doc_id", "local"), F.col("text")).withColumn("seq", F.lit(0).cast("long"))
    current = view.current_view(made).withColumnRenamed("payload", "text")
    return search.search(current, search.Request("and with"), seq="id").select("id", F.round("score", 9).alias("score"))
