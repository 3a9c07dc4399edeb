"""Further registered queries: single operators, each beside its SQL where there is one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnlake.functions import codecs
from cairnlake.functions import text as t
from cairnlake.operators import audit, catalog, chunking, kv, sets, sync, tree
from cairnlake.operators.closure import available, closure, first_sources
from cairnlake.operators.closure import proof_frontier as walk_to_proofs
from cairnlake.plans.spool import spool
from cairnlake.queries import COMPONENTS, DOCS, GRAPH, LEVELS, LINES, LINKS, LIVE, OBJECTS, PATHS, ROOTS, _links, query
from cairnlake.sources import archives
from cairnlake.sources.views import links, objects, payloads, table, url_path, urgent


def _src(df):
    return df.withColumn("src", F.substring("source", 4, 9).cast("long"))


# -- scalar functions


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, sha1('blob ' || strlen(text) || chr(0) || text) AS git_blob, strlen(text)::BIGINT AS size FROM documents")
def multi_hash(spark, sf):
    raw = F.col("text").cast("binary")
    got = table(spark, sf, "documents").select("doc_id", t.measurements(raw).alias("x"), t.git_object_digest("blob", raw).alias("git_blob"))
    return got.select("doc_id", "x.md5", "x.sha1", "x.sha256", "git_blob", "x.size")


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"))


@query("SELECT doc_id, text AS decoded, regexp_matches(text, '%[0-9A-Fa-f]{2}') AS had_escape FROM documents")
def percent_decode(spark, sf):
    """Whole texts, whose every byte that is no letter or digit is escaped first in the form of addresses."""
    escaped = F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))
    return table(spark, sf, "documents").select("doc_id", F.url_decode(escaped).alias("decoded"), F.col("text").rlike("%[0-9A-Fa-f]{2}").alias("had_escape"))


@query(f"WITH {PATHS}, {COMPONENTS} SELECT page_id, 'import/' || array_to_string(list_filter(p, lambda x: x NOT IN ('.', '..')), '/') AS name FROM parts")
def root_naming(spark, sf):
    p = F.filter(tree.parts(url_path()), lambda x: ~x.isin(".", ".."))
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("import/"), F.array_join(p, "/")).alias("name"))


@query("SELECT c_custkey, 'ws' || (c_custkey % 3) AS scope, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '/' || c_name END AS name FROM customer")
def scope_names(spark, sf):
    c = table(spark, sf, "customer")
    given = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ws"), F.col("c_custkey") % 3, F.lit(":"), "c_name")).otherwise(F.concat(F.lit("/"), "c_name"))
    got = c.select("c_custkey", t.scope_name(given, "").alias("x"))
    return got.select("c_custkey", F.when(F.col("x.scope") == "", F.concat(F.lit("ws"), F.col("c_custkey") % 3)).otherwise(F.col("x.scope")).alias("scope"), "x.name")


@query("SELECT c_custkey, c_custkey > 0 AND (c_custkey % 100) * 100 >= c_custkey * 80 AS pressured FROM customer")
def disk_pressure(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", t.pressured(F.col("c_custkey") % 100, F.col("c_custkey")).alias("pressured"))


@query("SELECT event_id, (event_id * 1000003)::DECIMAL(20,0) AS last_use FROM events")
def last_use_decode(spark, sf):
    raw = F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(F.col("event_id") * 1000003), 16, "0")))
    return table(spark, sf, "events").select("event_id", t.last_use(raw).alias("last_use"))


@query("SELECT doc_id, substr(hex(text), 21, 40) AS part FROM documents WHERE strlen(text) > 10")
def range_read(spark, sf):
    """Bytes 10 to 29 of each payload, put together from the chunks that its manifest names there."""
    docs = table(spark, sf, "documents")
    cut = docs.select("doc_id", F.posexplode(F.split("text", "(?<=\\n)", -1)).alias("ord", "part"))
    cut = cut.select("doc_id", F.col("ord").cast("long").alias("ord"), F.sha2("part", 256).alias("chunk"), F.octet_length("part").cast("long").alias("size"), F.col("part").cast("binary").alias("data"))
    stored = spool(cut, "range-chunks")
    got = chunking.read_range(stored.drop("data"), stored.dropDuplicates(["chunk"]).select("chunk", "data"), "doc_id", 10, 20)
    return got.select("doc_id", F.hex("data").alias("part"))


@query("SELECT l_orderkey, bool_and(prev IS NULL OR prev < l_partkey) AS in_order FROM (SELECT l_orderkey, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS prev FROM lineitem) GROUP BY 1")
def link_order(spark, sf):
    """Whether the parts that an order links to rise strictly in the order of its lines."""
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return per.select("l_orderkey", t.links_in_order(F.col("x.l_partkey")).alias("in_order"))


# -- directories as a mounted tree


@query(f"WITH {PATHS}, {COMPONENTS} SELECT p[1] AS name, count(*) AS n_pages, count(DISTINCT p[2]) AS n_children FROM parts GROUP BY 1")
def readdir_roots(spark, sf):
    p = table(spark, sf, "pages").select(tree.parts(url_path()).alias("p"))
    return p.groupBy(F.get("p", 0).alias("name")).agg(F.count("*").alias("n_pages"), F.count_distinct(F.get("p", 1)).alias("n_children"))


@query(f"WITH {PATHS}, {COMPONENTS}, e AS (SELECT DISTINCT p[1] AS dir, p[2] AS name, len(p) > 2 AS is_dir FROM parts WHERE len(p) >= 2) SELECT dir, name, bool_or(is_dir) AS is_dir, (row_number() OVER (PARTITION BY dir ORDER BY name))::BIGINT AS position FROM e GROUP BY dir, name")
def readdir_sorted(spark, sf):
    p = table(spark, sf, "pages").select(tree.parts(url_path()).alias("p")).where(F.size("p") >= 2)
    e = p.groupBy(F.get("p", 0).alias("dir"), F.get("p", 1).alias("name")).agg(F.bool_or(F.size("p") > 2).alias("is_dir"))
    return tree.numbered(e, ["dir"], [F.col("name").asc()])


# -- lookups and joins


@query("SELECT o_orderkey, o_custkey, c_name AS payload FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 2 = 0")
def validated_only(spark, sf):
    """Orders whose customer is validated, with its payload only."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("payload"), (F.col("c_custkey") % 2 == 0).alias("validated"))
    met = kv.multi_get(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")
    return met.where("validated").select("o_orderkey", "o_custkey", "payload")


@query(f"WITH {LINKS} SELECT dns, did, min((sns, sid))[1] AS sns, min((sns, sid))[2] AS sid FROM links GROUP BY 1, 2")
def first_source(spark, sf):
    return first_sources(links(spark, sf))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS inserted FROM events")
def distinct_insert(spark, sf):
    return kv.first_inserts(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "inserted")


@query("SELECT event_type, count(*) AS calls, min(ts) AS first_call, max(ts) AS last_call, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY 1")
def op_counters(spark, sf):
    return audit.counters(table(spark, sf, "events"), "event_type", "ts", F.col("value").cast("decimal(18,2)"))


@query("WITH e AS (SELECT user_id % 7 AS scope, event_id AS generation, event_type FROM events), p AS (SELECT scope, max(generation) AS pinned FROM e WHERE event_type = 'signup' GROUP BY 1) SELECT p.scope, pinned, count(e.generation) AS n_retained FROM p LEFT JOIN e ON e.scope = p.scope AND e.generation <= pinned GROUP BY 1, 2")
def max_pinned_generation(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 7).alias("scope"), F.col("event_id").alias("generation"), "event_type")
    return audit.pinned_objects(e.where("event_type = 'signup'").select("scope", "generation"), e)


@query(f"{GRAPH}, pins AS (SELECT ns, id FROM objects WHERE ns = 'customer' AND id % 4 = 0) SELECT p.ns, p.id FROM pins p WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.ns = p.ns AND l.id = p.id)")
def pin_conflicts(spark, sf):
    every = objects(spark, sf)
    doomed = audit.dead(every, closure(urgent(spark, sf), _links(spark, sf)))
    return every.where("ns = 'customer' AND id % 4 = 0").join(doomed, ["ns", "id"], "left_semi")


@query(f"WITH RECURSIVE {OBJECTS}, {LINKS}, roots(ns, id) AS (SELECT 'orders', o_orderkey::BIGINT FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT ns, id FROM objects WHERE ns = 'customer' AND id <= 20), {LIVE} SELECT ns, count(*) AS n FROM live GROUP BY ns")
def pin_scope_mark(spark, sf):
    young = objects(spark, sf).where("ns = 'customer' AND id <= 20")
    return closure(urgent(spark, sf).union(young), _links(spark, sf)).groupBy("ns").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {LINKS}, {ROOTS}, walk(ns, id, level) AS (SELECT ns, id, 0::BIGINT FROM roots UNION SELECT l.dns, l.did, w.level + 1 FROM walk w JOIN links l ON l.sns = w.ns AND l.sid = w.id WHERE NOT (w.ns = 'customer' AND w.id % 2 = 0)),
m AS (SELECT ns, id, min(level) AS level FROM walk GROUP BY 1, 2) SELECT level, ns = 'customer' AND id % 2 = 0 AS proven, count(*) AS n FROM m GROUP BY 1, 2""")
def proof_frontier(spark, sf):
    """A walk that ends where closures are proven: those of every other customer."""
    proven = objects(spark, sf).where("ns = 'customer' AND id % 2 = 0")
    return walk_to_proofs(urgent(spark, sf), _links(spark, sf), proven).groupBy("level", "proven").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {LINKS}, want(ns, id) AS (SELECT 'orders', o_orderkey::BIGINT FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT l.dns, l.did FROM want JOIN links l ON l.sns = want.ns AND l.sid = want.id),
have(ns, id) AS (SELECT 'orders', o_orderkey::BIGINT FROM orders WHERE o_orderkey % 3 = 1 UNION SELECT l.dns, l.did FROM have JOIN links l ON l.sns = have.ns AND l.sid = have.id) FROM want EXCEPT FROM have""")
def fetch_selection(spark, sf):
    o, out = objects(spark, sf).where("ns = 'orders'"), _links(spark, sf)
    return sets.difference(closure(o.where("id % 3 = 0"), out), closure(o.where("id % 3 = 1"), out), ["ns", "id"])


@query(f"""WITH RECURSIVE {LINKS}, {ROOTS}, away(ns, id) AS (SELECT 'part', p_partkey::BIGINT FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 'customer', c_custkey::BIGINT FROM customer WHERE c_custkey % 3 <> 1 UNION ALL SELECT 'orders', o_orderkey::BIGINT FROM orders WHERE o_orderkey % 2 = 0),
walk(ns, id) AS (SELECT ns, id FROM roots r WHERE NOT EXISTS (SELECT 1 FROM away a WHERE a.ns = r.ns AND a.id = r.id) UNION SELECT l.dns, l.did FROM walk w JOIN links l ON l.sns = w.ns AND l.sid = w.id WHERE NOT EXISTS (SELECT 1 FROM away a WHERE a.ns = l.dns AND a.id = l.did)) SELECT ns, id FROM walk""")
def availability_walk(spark, sf):
    """What is reached without passing through what is gone."""
    gone = objects(spark, sf).where("(ns = 'part' AND id % 50 = 0) OR (ns = 'customer' AND id % 3 <> 1) OR (ns = 'orders' AND id % 2 = 0)")
    return available(urgent(spark, sf), _links(spark, sf), gone).select("ns", "id")


@query("""WITH RECURSIVE refs AS (SELECT conv_id * 1000 + turn AS name, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS to_ref FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
w(name, tgt, hops) AS (SELECT name, name, 0 FROM refs UNION ALL SELECT w.name, r.to_ref, hops + 1 FROM w JOIN refs r ON r.name = w.tgt WHERE r.to_ref IS NOT NULL AND hops < 9)
SELECT name, max(w.tgt) FILTER (r.to_ref IS NULL) AS target, max(hops) FILTER (r.to_ref IS NULL)::BIGINT AS hops FROM w JOIN (SELECT name AS tgt, to_ref FROM refs) r USING (tgt) GROUP BY 1""")
def symbolic_refs(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    refs = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("name"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("to"))
    return tree.follow_refs(refs, 9)


# -- catalogs, repair, synchronization


@query("""WITH d AS (SELECT user_id, event_type, event_id % 2 AS later, arg_max(event_id, (ts, event_id)) AS value, arg_max(event_id % 5 = 0, (ts, event_id)) AS removed FROM events GROUP BY 1, 2, 3)
SELECT user_id, event_type, CASE WHEN n.value IS NOT NULL THEN n.value ELSE o.value END AS value, CASE WHEN n.value IS NOT NULL THEN n.removed ELSE o.removed END AS removed FROM (FROM d WHERE later = 0) o FULL JOIN (FROM d WHERE later = 1) n USING (user_id, event_type)""")
def delta_compose(spark, sf):
    """Two deltas of events, with removals, as one."""
    keys = ["user_id", "event_type"]
    state = F.struct(F.col("event_id").alias("value"), (F.col("event_id") % 5 == 0).alias("removed"))
    e = table(spark, sf, "events")
    older, newer = (catalog.latest(e.where(F.col("event_id") % 2 == k), keys, [F.col("ts"), F.col("event_id")], state).select(*keys, "value.*") for k in (0, 1))
    return catalog.compose(older, newer, keys)


@query(f"WITH RECURSIVE {LINKS}, {ROOTS}, {LIVE}, s AS (SELECT c_custkey::BIGINT AS id, (('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT >> 26) AS shard FROM customer) SELECT shard, count(*) AS n, count(*) - count(l.id) AS n_lost, count(*) > count(l.id) AS rewrite FROM s LEFT JOIN live l ON l.ns = 'customer' AND l.id = s.id GROUP BY 1")
def dense_retention(spark, sf):
    """Shards of customers, and which of them a collection writes anew."""
    c = table(spark, sf, "customer").select(F.lit("customer").alias("ns"), F.col("c_custkey").cast("long").alias("id"))
    return catalog.dense_retention(catalog.shards(c, F.sha2(F.col("id").cast("string"), 256), 6), closure(urgent(spark, sf), _links(spark, sf)), ["ns", "id"])


@query(f"""WITH {DOCS}, s AS (SELECT doc_id, digest, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'healthy' WHEN doc_id % 2 = 0 THEN 'repaired' ELSE 'lost' END AS state, text FROM docs)
SELECT doc_id, digest, state, CASE WHEN state <> 'lost' THEN strlen(text) END::BIGINT AS size FROM s""")
def self_repairing_read(spark, sf):
    """Near copies are missing for every third document and damaged for every fifth; far copies exist for even ones."""
    docs = payloads(spark, sf).select("doc_id", "digest", F.col("text").cast("binary").alias("data"))
    near = docs.where("doc_id % 3 <> 0").withColumn("data", F.when(F.col("doc_id") % 5 == 0, F.concat("data", F.lit(b"x"))).otherwise(F.col("data")))
    got = catalog.repairing_read(docs, near, docs.where("doc_id % 2 = 0"), "doc_id")
    return got.select("doc_id", "digest", "state", F.octet_length("data").cast("long").alias("size"))


@query(f"WITH {DOCS} SELECT digest, CASE WHEN min(src % 4) = max(src % 4) THEN min(src % 4) END AS fact, count(*) AS n, min(src % 4) <> max(src % 4) AS quarantined FROM docs GROUP BY 1")
def facts_quarantine(spark, sf):
    """Facts on a payload that its holders disagree on are in quarantine."""
    return audit.quarantine(_src(payloads(spark, sf)).select("digest", (F.col("src") % 4).alias("fact")), "digest", "fact")


@query(f"WITH RECURSIVE {OBJECTS}, {LINKS}, {ROOTS}, {LIVE}, proofs AS (SELECT ns, id FROM objects WHERE ns = 'customer' OR (ns = 'orders' AND id % 4 = 0)) SELECT ns, id FROM (FROM proofs EXCEPT SELECT ns, id FROM live)")
def orphan_proofs(spark, sf):
    """Closure proofs whose object a collection has dropped."""
    proofs = objects(spark, sf).where("ns = 'customer' OR (ns = 'orders' AND id % 4 = 0)")
    return sets.difference(proofs, closure(urgent(spark, sf), _links(spark, sf)), ["ns", "id"])


@query(f"""WITH RECURSIVE {OBJECTS}, {LINKS}, {ROOTS}, here AS (SELECT ns, id FROM objects WHERE NOT (ns = 'part' AND id % 20 = 0) AND NOT (ns = 'orders' AND id % 9 = 0)),
walk(ns, id) AS (SELECT DISTINCT dns, did FROM links l WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.ns = l.dns AND h.id = l.did) UNION SELECT l.sns, l.sid FROM walk w JOIN links l ON l.dns = w.ns AND l.did = w.id)
SELECT r.ns, r.id, CASE WHEN h.id IS NULL THEN 'missing' WHEN w.id IS NOT NULL THEN 'incomplete' ELSE 'complete' END AS status FROM roots r LEFT JOIN here h USING (ns, id) LEFT JOIN walk w USING (ns, id)""")
def finish_statuses(spark, sf):
    """Urgent orders transferred to a destination that lacks some parts and orders."""
    here = objects(spark, sf).where("NOT (ns = 'part' AND id % 20 = 0) AND NOT (ns = 'orders' AND id % 9 = 0)")
    return sync.finish_statuses(urgent(spark, sf), _links(spark, sf), here)


@query("SELECT c_custkey AS name, c_custkey % 3 <> 0 AS evictable, CASE WHEN c_custkey % 3 <> 0 THEN greatest(max(o_orderdate), TIMESTAMP '1995-06-01') ELSE TIMESTAMP '1995-06-01' END AS last_use FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def root_retention(spark, sf):
    """Roots of customers, touched by their orders; permanent ones are not."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), (F.col("c_custkey") % 3 != 0).alias("evictable"), F.lit("1995-06-01").cast("timestamp_ntz").alias("last_use"))
    return sync.touch(c, table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderdate").alias("at")))


@query(f"WITH {DOCS}, {LINES}, a AS (SELECT DISTINCT line FROM lines WHERE src < 10), b AS (SELECT DISTINCT line FROM lines WHERE src >= 10) SELECT count(*) AS n_shared, sum(strlen(line))::BIGINT AS n_bytes FROM a JOIN b USING (line)")
def shared_chunks(spark, sf):
    d = _src(table(spark, sf, "documents"))
    cut = lambda x: chunking.line_chunks(x, "doc_id", "text").select("chunk", "size").distinct()
    return cut(d.where("src < 10")).join(cut(d.where("src >= 10")).select("chunk"), "chunk", "left_semi").agg(F.count("*").alias("n_shared"), F.sum("size").alias("n_bytes"))


@query(f"WITH {DOCS}, o AS (SELECT source, doc_id, digest FROM docs WHERE doc_id % 2 = 0), n AS (SELECT source, doc_id - 1 AS doc_id, digest FROM docs WHERE doc_id % 2 = 1) SELECT o.doc_id, o.digest AS old_digest, n.digest AS new_digest FROM o JOIN n USING (doc_id) WHERE o.digest <> n.digest")
def slice_base_pairs(spark, sf):
    docs = payloads(spark, sf)
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.col("digest").alias("old_digest"))
    new = docs.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("digest").alias("new_digest"))
    return old.join(new, "doc_id").where("old_digest <> new_digest")


@query("SELECT source || '-' || (doc_id // 64) AS archive, count(*) AS n, sum(strlen(text))::BIGINT AS n_bytes, count(DISTINCT sha256(text)) AS n_payloads FROM documents GROUP BY 1")
def archive_stats(spark, sf):
    """Archives as they are read back: entries, bytes and distinct payloads."""
    return _archives(spark, sf).groupBy("archive").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("n_bytes"), F.count_distinct("sha256").alias("n_payloads"))


@query("WITH p AS (SELECT page_id AS k, strlen(html)::BIGINT AS size FROM pages ORDER BY page_id LIMIT 1024), r AS (SELECT k, size, sum(size) OVER (ORDER BY k) AS upto, row_number() OVER (ORDER BY k) AS n FROM p) SELECT k, size FROM r WHERE upto <= 50000 OR n = 1")
def record_batch_budget(spark, sf):
    """The first answer over all pages: 1,024 records and 50,000 bytes at most."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("k"), F.octet_length("html").cast("long").alias("size"))
    return kv.page_bytes(p, "k", F.col("size"), 1024, 50_000)


@query("""WITH n AS (SELECT c_mktsegment || '/n' || c_nationkey || '/c' || c_custkey AS name FROM customer), r AS (SELECT DISTINCT c_mktsegment AS prefix, 'segment' AS policy FROM customer WHERE c_mktsegment < 'F' UNION ALL SELECT DISTINCT c_mktsegment || '/n' || c_nationkey, 'nation' FROM customer WHERE c_nationkey % 4 = 0 UNION ALL SELECT c_mktsegment || '/n' || c_nationkey || '/c' || c_custkey, 'own' FROM customer WHERE c_custkey % 10 = 0)
SELECT name, arg_max(policy, strlen(prefix)) AS policy FROM n LEFT JOIN r ON name = prefix OR starts_with(name, prefix || '/') GROUP BY 1""")
def policy_join(spark, sf):
    """The rule of the longest prefix for each root."""
    c = table(spark, sf, "customer")
    at = [F.col("c_mktsegment"), F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")]
    rule = lambda rows, n, policy: rows.select(F.concat_ws("/", *at[:n]).alias("prefix"), F.lit(policy).alias("policy")).distinct()
    rules = rule(c.where("c_mktsegment < 'F'"), 1, "segment").union(rule(c.where("c_nationkey % 4 = 0"), 2, "nation")).union(rule(c.where("c_custkey % 10 = 0"), 3, "own"))
    return sync.policies(c.select(F.concat_ws("/", *at).alias("name")), rules)


def _archives(spark, sf):
    d = table(spark, sf, "documents").select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 64)).alias("archive"), F.concat_ws("/", "source", F.col("doc_id")).alias("path"), "text")
    made = d.groupBy("archive").agg(F.collect_list(F.struct("path", "text")).alias("files"))  # 64 files at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [archives.write_tar([(f["path"], (f["text"] or "").encode(), False) for f in own]) for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["path", "content"])

    return archives.parse_tar(made.mapInArrow(run, "path string, content binary"))


# -- what SQL cannot express: codecs, content-defined chunks, proofs, archives


@query(None)
def cdc_chunks(spark, sf):
    return chunking.content_chunks(table(spark, sf, "documents"), "doc_id", F.col("text").cast("binary"), 512)


@query(None)
def blake3_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.digest_text(codecs.blake3_udf(F.col("text").cast("binary"))).alias("digest"))


@query(None)
def codec_roundtrip(spark, sf):
    """Order records with their links, encoded and decoded again."""
    out = _links(spark, sf).where("sns = 'orders'").groupBy("sid").agg(F.array_sort(F.collect_set(F.struct("dns", F.col("did").cast("string").alias("id")))).alias("links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, ok = [], []
            for i, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys = sorted((f"{x['dns']}.v1", x["id"].encode()) for x in own)
                raw.append(codecs.encode_record(("orders.v1", str(i).encode()), bytes(32), len(keys), keys))
                ok.append(codecs.decode_record(raw[-1])[3] == keys)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(ok)], ["id", "record", "equal"])

    return out.mapInArrow(run, "id long, record binary, equal boolean")


@query(None)
def directory_digest(spark, sf):
    """Digests of the directories of page addresses, bottom-up: a join-free aggregation for each level."""
    files = table(spark, sf, "pages").select(tree.parts(url_path()).alias("p"), F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    files = files.groupBy(F.array_join("p", "/").alias("path")).agg(F.min(F.struct("digest", "size")).alias("x")).select("path", "x.*", F.lit("file").alias("kind"))
    return tree.directory_digests(files)


@query("""WITH RECURSIVE t AS (SELECT doc_id, hex(text) AS x, strlen(text) AS n FROM documents WHERE strlen(text) > 1000),
l AS (SELECT doc_id, n, list_transform(range(0, (n + 255) // 256), lambda k: sha256(unhex('00' || substr(x, 1 + 512 * k, 512)))) AS h FROM t),
w(doc_id, h, a, b, c) AS (SELECT doc_id, h, 3::BIGINT, (least(n, 1500) - 1) // 256, 0::BIGINT FROM l UNION ALL
 SELECT doc_id, list_transform(range(1, len(h) + 1, 2), lambda i: CASE WHEN i < len(h) THEN sha256(unhex('01' || h[i] || h[i + 1])) ELSE h[i] END), a // 2, b // 2, c + a % 2 + CASE WHEN b % 2 = 0 AND b + 1 < len(h) THEN 1 ELSE 0 END FROM w WHERE len(h) > 1)
SELECT w.doc_id, h[1] AS root, c::BIGINT AS n_hashes, substr(x, 2001, 1000) AS part FROM w JOIN t USING (doc_id) WHERE len(h) = 1""")
def verified_range(spark, sf):
    """Bytes 1000 to 1499 of each text, proved and verified against the root of its hash tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                if len(raw) > 1000:
                    root = codecs.block_hashes(raw, 256)[-1][0]
                    blocks, proof = codecs.prove_range(raw, 1000, 500, 256)
                    rows.append((i, root.hex(), len(proof), codecs.verify_range(root, len(raw), 1000, 500, blocks, proof, 256).hex().upper()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))], ["doc_id", "root", "n_hashes", "part"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, root string, n_hashes long, part string")


@query(None)
def sliced_delta(spark, sf):
    """Each text as a delta on the earlier text that shares most bytes of content-defined chunks; what was copied, and that it decodes.

    Equal texts have the first of them as base; the first ones are compared by the chunks they share, wherever these
    stand, each with the eight newest earlier texts that hold it, as the index keeps. A text without a base is one literal.
    """
    d = table(spark, sf, "documents").select("doc_id", "text")
    first = spool(d.groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id")), "delta-first")
    raw = F.col("text").cast("binary")
    once = d.join(first.select("doc_id"), "doc_id", "left_semi")
    chunks = spool(chunking.content_chunks(once, "doc_id", raw, 128).groupBy("doc_id", "chunk").agg(F.sum("size").alias("size")), "delta-chunks")
    shared = chunks.join(chunks.groupBy("chunk").agg(F.count("*").alias("c")).where("c > 1").select("chunk"), "chunk")
    met = chunking.earlier_holders(shared, "doc_id").groupBy("doc_id", "base_id").agg(F.sum(F.least("size", "held")).alias("n"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("base_id")).alias("b"))).alias("x")).select("doc_id", (-F.col("x.b")).alias("base_id"))
    equal = d.select("doc_id", F.sha2("text", 256).alias("k")).join(first.withColumnRenamed("doc_id", "base_id"), "k").where("doc_id <> base_id").select("doc_id", "base_id")
    bases = spool(best.union(equal), "delta-bases")
    held = d.select(F.col("doc_id").alias("base_id"), F.col("text").alias("base"))
    pairs = d.join(bases, "doc_id", "left").join(held, "base_id", "left").select("doc_id", "base_id", "base", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, j, base, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                old, new = (base or "").encode(), (text or "").encode()
                tokens = codecs.encode_delta(old, new)
                copied = sum(x for kind, _, x in tokens if kind == "copy")
                rows.append((i, j, len(tokens), copied, len(new) - copied, codecs.decode_delta(old, tokens) == new))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate((*[pa.int64()] * 5, pa.bool_()))], ["doc_id", "base_id", "n_tokens", "copy_bytes", "literal_bytes", "equal"])

    return pairs.mapInArrow(run, "doc_id long, base_id long, n_tokens long, copy_bytes long, literal_bytes long, equal boolean")


@query("SELECT source || '-' || (doc_id // 64) AS archive, source || '/' || doc_id AS path, 'file' AS kind, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents")
def tar_roundtrip(spark, sf):
    """Documents written to archives of 64 at most, and read back as entries."""
    return _archives(spark, sf).select("archive", "path", "kind", "size", "sha256")


_LE = "unhex(format('" + "{:02x}" * 4 + "00000000', strlen(text) % 256, (strlen(text) // 256) % 256, (strlen(text) // 65536) % 256, strlen(text) // 16777216))"
_NAR = "unhex('" + archives.nar_head().hex() + "') || " + _LE + " || encode(text) || unhex(repeat('00', ((8 - strlen(text) % 8) % 8)::INT)) || unhex('" + archives.nar_tail().hex() + "')"


@query(f"SELECT doc_id, octet_length({_NAR})::BIGINT AS nar_size, sha256({_NAR}) AS nar_sha256 FROM documents")
def nar_measure(spark, sf):
    """Size and SHA-256 of each text as a one-file archive, made by column expressions."""
    got = table(spark, sf, "documents").select("doc_id", archives.nar_file(F.col("text").cast("binary")).alias("x"))
    return got.select("doc_id", F.octet_length("x").cast("long").alias("nar_size"), F.sha2("x", 256).alias("nar_sha256"))
