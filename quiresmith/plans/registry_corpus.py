"""Registered queries of sources, sinks, names and corpus plans, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions import names, numbers, strings
from quiresmith.operators import aggregates, relations, sequences, upsert
from quiresmith.plans import catalog, corpus, workbook
from quiresmith.plans.registry import FAULTS_SQL, PAPERS, _faults, _papers, grey_levels, query
from quiresmith.session import load, materialize, shared_path
from quiresmith.sources import png, readers, schemas, sinks
from quiresmith.streaming import logs

#: The audit rows of PAPERS, with the fault of a pair that disagrees.
MATCHED = (
    PAPERS
    + """,
audited AS (SELECT m.name, m.mate, m.own AS questions, m.pictures, list_sort(list_concat(m.faults, CASE WHEN len(p.own) <> len(m.own) THEN ['pair-mismatch'] ELSE [] END)) AS faults, p.own AS theirs
   FROM mated m LEFT JOIN rows0 p ON m.mate = p.name),
said AS (SELECT *, len(list_filter(faults, lambda x: x NOT IN ('shredded', 'mixed-rotation', 'pair-mismatch', 'clipped', 'stale'))) = 0 AND questions = list_transform(range(1, len(questions) + 1), lambda x: x::INTEGER) AS sound FROM audited)
"""
)


def _audited(spark, d) -> DataFrame:
    rows, _ = _papers(spark, d)
    mates = rows.select(F.col("name").alias("_m"), F.size("questions").alias("_n"))
    joined = rows.withColumn("_mate", names.partner(F.col("name"))).join(mates, F.col("_mate") == F.col("_m"), "left")
    return joined.select("name", "questions", relations.with_fault(F.col("faults"), "pair-mismatch", F.col("_n") != F.size("questions")).alias("faults"), "ord")


@query(MATCHED + "SELECT a.name, CASE WHEN b.sound THEN len(b.questions) END::INTEGER AS target_size, CASE WHEN b.sound THEN 'match' ELSE 'stuck' END AS action FROM said a JOIN said b ON a.mate = b.name WHERE list_contains(a.faults, 'pair-mismatch') AND NOT a.sound")
def match_ups(spark, d):
    """What the sides of pairs that disagree learn from each other."""
    return corpus.match_ups(_audited(spark, d)).select("name", F.when(F.col("target").isNotNull(), F.size("target")).alias("target_size"), "action")


@query("""
WITH t AS (SELECT l_orderkey, list_sort(list(l_linenumber) FILTER (l_returnflag <> 'A')) AS before, list_sort(list(l_linenumber) FILTER (l_returnflag <> 'R')) AS after,
   list_transform(range(1, 1 + count(*) - (l_orderkey % 2)), lambda x: x::INTEGER) AS target, CASE WHEN l_orderkey % 3 = 0 THEN 'family' ELSE 'partner' END AS source, CASE WHEN l_orderkey % 11 = 0 THEN 'boom' END AS error FROM lineitem GROUP BY l_orderkey),
n AS (SELECT *, coalesce(len(before), 0) AS b, coalesce(len(after), 0) AS a FROM t)
SELECT l_orderkey::VARCHAR AS name, CASE WHEN error IS NOT NULL THEN 'error' WHEN a = 0 OR coalesce(before, []) = after THEN 'no better'
   WHEN a < b AND NOT (source = 'family' AND after = target) THEN 'worse' WHEN after = target THEN 'repaired' ELSE 'improved' END AS outcome FROM n
""")
def repair_outcome(spark, d):
    """What came of reading papers again."""
    lines = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")

    def held(but: str):
        kept = F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != but, F.col("l_linenumber"))))
        return F.when(F.size(kept) > 0, kept)

    tried = lines.groupBy("l_orderkey").agg(held("A").alias("before"), held("R").alias("after"), F.count(F.lit(1)).cast("int").alias("n"))
    size = F.col("n") - (F.col("l_orderkey") % 2).cast("int")
    target = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    tried = tried.select(F.col("l_orderkey").cast("string").alias("name"), "before", "after", target.alias("target"), F.when(F.col("l_orderkey") % 3 == 0, "family").otherwise("partner").alias("source"), F.when(F.col("l_orderkey") % 11 == 0, "boom").alias("error"))
    return corpus.repair_outcome(tried).select("name", "outcome")


@query(PAPERS + """
SELECT m.name, CASE WHEN coalesce(len(list_filter(p.faults, lambda x: x <> 'shredded')) = 0, false) AND (len(m.own) % 3 = 0 OR len(m.own) = len(p.own)) THEN 'keep' ELSE 'undo' END AS action FROM mated m LEFT JOIN rows0 p ON m.mate = p.name
""")
def revert_plan(spark, d):
    """Repairs to keep and to undo."""
    rows, _ = _papers(spark, d)
    repaired = rows.select("name", F.when(F.size("questions") % 3 == 0, F.array().cast("array<int>")).otherwise(F.col("questions")).alias("before"), F.col("questions").alias("after"))
    return corpus.revert_plan(repaired, rows)


@query(PAPERS + """,
docs AS (SELECT name, own, faults, left(name, 4) AS syllabus, regexp_extract(name, '_(s[0-9]{2})_', 1) AS session, regexp_extract(name, '_([0-9]+)$', 1) AS variant, CASE WHEN contains(name, '_qp_') THEN 'qp' ELSE 'ms' END AS side FROM rows0),
fit AS (SELECT syllabus, session, variant, min(len(own)) AS questions FROM docs GROUP BY 1, 2, 3 HAVING count(DISTINCT side) = 2 AND count(DISTINCT own) = 1 AND bool_and(own = list_transform(range(1, len(own) + 1), lambda x: x::INTEGER))
   AND NOT bool_or(len(list_filter(faults, lambda x: x NOT IN ('shredded', 'mixed-rotation', 'stale'))) > 0) AND NOT bool_or(len(own) = 7)),
r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY syllabus, session) AS rn FROM fit)
SELECT syllabus, session, variant, questions::INTEGER AS questions FROM r WHERE rn <= 3 ORDER BY rn, syllabus, session LIMIT 10
""")
def hand_over(spark, d):
    """Pairs to hand over, whole at both sizes, spread over variants."""
    rows, artifacts = _papers(spark, d)
    both = artifacts.withColumn("size", F.explode(F.array(F.lit("web"), F.lit("full"))))
    pending = rows.where(F.size("questions") == 7).select("name")
    return corpus.hand_over(both, rows, pending)


@query(PAPERS + "SELECT name, (len(own) - (length(own::VARCHAR) % 2))::INTEGER AS was, len(own)::INTEGER AS now FROM rows0 WHERE length(own::VARCHAR) % 2 = 1")
def changed_counts(spark, d):
    """Papers whose item count is no longer what the log has."""
    rows, _ = _papers(spark, d)
    shown = F.length(F.concat(F.lit("["), F.array_join(F.col("questions").cast("array<string>"), ", "), F.lit("]")))
    log = rows.select("name", (F.size("questions") - shown % 2).cast("int").alias("questions"))
    return corpus.changed_counts(rows, log)


COUNTED = {"9700_s00_qp_0": 3, "9701_s00_ms_1": 5, "9702_s01_qp_2": 2}


@query(PAPERS + "SELECT name, CASE name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in COUNTED.items()) + f" END::INTEGER AS n FROM rows0 WHERE name IN ({', '.join(map(repr, COUNTED))})")
def by_hand(spark, d):
    """Papers whose items were counted by hand."""
    rows, _ = _papers(spark, d)
    return corpus.by_hand(rows, COUNTED).select("name", F.size("target").alias("n"))


@query(PAPERS + "SELECT left(name, 4) AS syllabus, count(*) AS papers, sum(pictures)::BIGINT AS pictures FROM rows0 GROUP BY 1")
def pictures_by_syllabus(spark, d):
    """Papers and pictures of each syllabus."""
    rows, _ = _papers(spark, d)
    return aggregates.pictures_by_syllabus(rows.select("name", F.size("questions").alias("pictures")))


AGREED = PAPERS + """,
keyed AS (SELECT left(name, 4) || '_' || regexp_extract(name, '_(s[0-9]{2})_', 1) || '_' || regexp_extract(name, '_([0-9]+)$', 1) AS paper, left(name, 4) || '_' || regexp_extract(name, '_([0-9])[0-9]*$', 1) AS family,
   contains(name, '_qp_') AS qp, list_sort(list_distinct(own)) AS own FROM rows0),
agreed AS (SELECT a.paper, a.family, len(a.own) AS n FROM keyed a JOIN keyed b ON a.paper = b.paper AND a.qp AND NOT b.qp AND a.own = b.own),
tallied AS (SELECT family, n, count(*) AS hits FROM agreed GROUP BY 1, 2),
shape AS (SELECT family, n AS questions, hits, sum(hits) OVER (PARTITION BY family) AS papers, row_number() OVER (PARTITION BY family ORDER BY hits DESC, n) AS rn, list({q: n, h: hits}) OVER (PARTITION BY family) AS seen FROM tallied)
"""


@query(AGREED + "SELECT family, questions::BIGINT AS questions, papers::BIGINT AS papers, array_to_string(list_transform(list_sort(seen), lambda s: s.q || ':' || s.h), ',') AS seen, hits / papers >= 0.9 AND papers >= 12 AS certain FROM shape WHERE rn = 1")
def agreed_shapes(spark, d):
    """Family shapes by the papers whose sides agree, with the sizes seen."""
    _, artifacts = _papers(spark, d)
    shapes = aggregates.agreed_shapes(artifacts)
    seen = F.array_join(F.transform(F.map_entries("seen"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return shapes.select("family", "questions", "papers", seen.alias("seen"), "certain")


SURE_SQL = """
WITH p AS (SELECT o_orderkey, (9700 + o_orderkey % 4)::VARCHAR AS syllabus, 's' || lpad((o_orderkey // 40 % 100)::VARCHAR, 2, '0') AS session, (o_custkey % 3)::VARCHAR || (o_orderkey // 4000)::VARCHAR AS variant, o_orderkey // 4 % 10 = 0 AS gap FROM orders),
n AS (SELECT syllabus || '_' || session || '_qp_' || variant AS name, syllabus || '_' || left(variant, 1) AS family, bool_or(gap) AS gap FROM p GROUP BY syllabus, session, variant),
f AS (SELECT family, count(*) AS papers, (CASE WHEN family LIKE '9700%' THEN count(*) ELSE count(*) FILTER (NOT gap) END) AS hits FROM n GROUP BY 1)
"""


@query(SURE_SQL + "SELECT n.name, CASE WHEN f.hits / f.papers >= 0.9 AND f.papers >= 12 THEN 'family' ELSE 'gap' END AS source, 4 + CASE WHEN NOT (f.hits / f.papers >= 0.9 AND f.papers >= 12) THEN 1 ELSE 0 END AS target_size FROM n JOIN f USING (family) WHERE gap")
def repair_by_family(spark, d):
    """What papers with a gap should hold, where families are certain by the library's own thresholds."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    session = F.concat(F.lit("s"), F.lpad((F.floor(key / 40) % 100).cast("string"), 2, "0"))
    variant = F.concat((cust % 3).cast("string"), F.floor(key / 4000).cast("string"))
    name = F.concat_ws("_", (key % 4 + 9700).cast("string"), session, F.lit("qp"), variant)
    papers = load(spark, d, "orders", "o_orderkey", "o_custkey").groupBy(name.alias("name")).agg(F.bool_or(F.floor(key / 4) % 10 == 0).alias("gap"))
    # One syllabus always has four items; in the others a gap hides that there are five.
    size = F.when(F.col("gap") & ~F.col("name").startswith("9700"), 5).otherwise(4)
    items = papers.select(names.family(F.col("name")).alias("family"), F.col("name").alias("paper"), F.explode(F.sequence(F.lit(1), size)).alias("number"))
    shapes = aggregates.family_shape(items)
    rows = papers.select("name", F.when(F.col("gap"), F.array(F.lit(1), F.lit(2), F.lit(5))).otherwise(F.sequence(F.lit(1), F.lit(4))).alias("questions"), F.when(F.col("gap"), F.array(F.lit("gap"))).otherwise(F.array().cast("array<string>")).alias("faults"), F.lit(0).alias("ord"))
    return corpus.repair_targets(rows, shapes).select("name", "source", F.size("target").alias("target_size"))


@query("""
WITH s AS (SELECT l_orderkey AS doc, list_sort(list(l_linenumber)) AS questions, bool_or(l_returnflag = 'A') AS shredded, count(DISTINCT l_linestatus) AS turns, bool_or(l_tax > 0.07) AS part, bool_or(l_discount > 0.09) AS foreign_, CASE WHEN bool_or(l_suppkey % 7 = 0) THEN 'PUBLISHED' END AS furniture FROM lineitem GROUP BY 1)
SELECT o_orderkey::VARCHAR AS name, coalesce(array_to_string(questions, ','), '') AS questions, array_to_string(list_sort(list_filter([CASE WHEN shredded THEN 'shredded' END, CASE WHEN turns > 1 THEN 'mixed-rotation' END, CASE WHEN questions IS NULL THEN 'no-questions' END,
   CASE WHEN questions <> list_transform(range(1, len(questions) + 1), lambda x: x::INTEGER) THEN 'gap' END, CASE WHEN part THEN 'missing-part' END, CASE WHEN foreign_ THEN 'foreign-label' END, CASE WHEN furniture IS NOT NULL THEN 'furniture' END], lambda x: x IS NOT NULL)), ',') AS faults
FROM orders LEFT JOIN s ON o_orderkey = doc
""")
def audit(spark, d):
    """Audit rows of documents made of orders: what was read, and all faults of the reading."""
    lines = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_tax", "l_discount", "l_suppkey").withColumn("doc", F.col("l_orderkey").cast("string"))
    documents = load(spark, d, "orders", F.col("o_orderkey").cast("string").alias("doc"), F.lit("qp").alias("kind"))
    starts = lines.select("doc", F.lit(0).alias("page"), (F.col("l_linenumber") * 10.0).alias("y"), F.col("l_linenumber").alias("number"))
    intervals = lines.select("doc", F.col("l_linenumber").alias("number"), F.when(F.col("l_tax") > 0.07, "b").otherwise("a").alias("first_part"), (F.col("l_discount") > 0.09).alias("foreign"))
    flags = lines.groupBy("doc").agg(F.bool_or(F.col("l_returnflag") == "A").alias("shredded"), F.count_distinct("l_linestatus").alias("rotations"), F.max(F.when(F.col("l_suppkey") % 7 == 0, "PUBLISHED")).alias("furniture"))
    rows = corpus.audit(documents, starts, intervals, flags.withColumn("error", F.lit(None).cast("string")))
    return rows.select("name", F.array_join(F.col("questions").cast("array<string>"), ",").alias("questions"), F.array_join("faults", ",").alias("faults"))


@query(PAPERS + """
SELECT m.name, array_to_string(list_sort(list_distinct(list_concat(m.faults, list_filter([CASE WHEN len(m.own) % 5 = 0 THEN 'no-output' END, CASE WHEN m.own[1] = 2 THEN 'clipped' END,
   CASE WHEN len(list_filter(m.own, lambda x: x <> 3)) NOT IN (0, len(m.own)) THEN 'stale' END, CASE WHEN len(p.own) <> len(m.own) THEN 'pair-mismatch' END], lambda x: x IS NOT NULL)))), ',') AS faults
FROM mated m LEFT JOIN rows0 p ON m.mate = p.name
""")
def audit_outputs(spark, d):
    """Audit rows with what their outputs show: nothing written, cut, stale, or another count than the partner's."""
    rows, artifacts = _papers(spark, d)
    edges = rows.select(F.col("name").alias("paper"), F.when(F.get("questions", F.lit(0)) == 2, 0.9).otherwise(0.0).alias("worst"))
    written = rows.where(F.size("questions") % 5 != 0).select(F.col("name").alias("paper"))
    out = corpus.audit_outputs(rows.withColumn("kind", F.lit("qp")), artifacts.where("number <> 3"), edges, written)
    return out.select("name", F.array_join("faults", ",").alias("faults"))


@query("""
WITH f AS (SELECT l_returnflag AS name, l_suppkey AS k FROM lineitem UNION SELECT o_orderpriority, o_custkey FROM orders UNION SELECT c_mktsegment, c_nationkey FROM customer) SELECT * FROM f
""")
def union_of_lists(spark, d):
    """Names of three lists, each once."""
    parts = [load(spark, d, t, F.col(a).alias("name"), F.col(b).cast("long").alias("k")) for t, a, b in (("lineitem", "l_returnflag", "l_suppkey"), ("orders", "o_orderpriority", "o_custkey"), ("customer", "c_mktsegment", "c_nationkey"))]
    return relations.union_of(*parts)


@query("SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag) FILTER (l_linestatus = 'O'))) IS NOT DISTINCT FROM list_sort(list_distinct(list(l_returnflag) FILTER (l_linestatus = 'F'))) AS same FROM lineitem GROUP BY 1")
def same_sides(spark, d):
    """Whether both sides of an order hold the same modes."""
    lines = load(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag")
    sides = lines.groupBy("l_orderkey").agg(*(F.collect_list(F.when(F.col("l_linestatus") == s, F.col("l_returnflag"))).alias(s) for s in "OF"))
    return sides.select("l_orderkey", relations.same_members(F.col("O"), F.col("F")).alias("same"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem) SELECT l_orderkey, l_linenumber, position::INTEGER AS position FROM r WHERE position = l_orderkey % 4")
def at_positions(spark, d):
    """The line of each order at a wanted place."""
    lines = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    wanted = lines.select("l_orderkey", (F.col("l_orderkey") % 4).cast("int").alias("position")).distinct()
    return relations.at_positions(lines, wanted, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "position")


CELLS = """
WITH c AS (SELECT c_nationkey::VARCHAR AS sheet, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, c_custkey, c_name FROM customer),
h AS (SELECT sheet, 1 + sheet::INTEGER % 3 AS head FROM c GROUP BY 1)
"""


@query(CELLS + "SELECT sheet, (head + k)::INTEGER AS row, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'physics' END AS subject, 's' || c_custkey || '_Q.png' AS q_filename, c_name AS chapter FROM c JOIN h USING (sheet)")
def sheet_rows(spark, d):
    """Catalogue rows below the best header of sheets made of customers, whose headings lie on different rows."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = load(spark, d, "customer", "c_custkey", "c_nationkey", "c_name").withColumn("k", place).withColumn("sheet", F.col("c_nationkey").cast("string"))
    head = (F.col("c_nationkey") % 3 + 1).cast("int")

    def cell(row, col: int, value):
        return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"))

    body = [cell(head + F.col("k"), 2, F.when(F.col("c_custkey") % 4 != 0, "physics")), cell(head + F.col("k"), 3, F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit("_Q.png"))), cell(head + F.col("k"), 5, F.col("c_name"))]
    heads = [cell(head, 2, F.lit(" Subject ")), cell(head, 3, F.lit("Q_FileName")), cell(head, 5, F.lit("Topic")), cell(head, 7, F.lit("subject")), cell(F.lit(9), 2, F.lit("Subject"))]
    cells = rows.select("sheet", F.explode(F.array(*body)).alias("c")).unionByName(rows.where("k = 1").select("sheet", F.explode(F.array(*heads[:4])).alias("c"))).select("sheet", "c.*")
    return readers.sheet_rows(cells).select("sheet", "row", "subject", "q_filename", "chapter")


@query("""
WITH f AS (SELECT o_orderkey, 'p' || (o_custkey % 50) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_q' || (o_orderkey % 12) END AS stem, 'a_' || CASE WHEN o_orderkey % 5 = 0 THEN 'web' ELSE 'x' END AS folder, CASE WHEN o_orderkey % 7 = 0 THEN 'aside' ELSE 'main' END AS top, o_custkey AS bytes FROM orders)
SELECT o_orderkey, folder, regexp_extract(stem, '^(.*)_q([0-9]+)$', 1) AS paper, regexp_extract(stem, '_q([0-9]+)$', 1)::INTEGER AS number, bytes FROM f WHERE stem LIKE '%\\_q%' ESCAPE '\\' AND folder <> 'a_web' AND top <> 'aside'
""")
def artifacts(spark, d):
    """Item pictures of the working set."""
    key = F.col("o_orderkey")
    stem = F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string"), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("_q"), (key % 12).cast("string"))))
    folder = F.concat(F.lit("/"), F.when(key % 7 == 0, "aside").otherwise("main"), F.lit("/a_"), F.when(key % 5 == 0, "web").otherwise("x"))
    files = load(spark, d, "orders", "o_orderkey", "o_custkey").select(F.concat(folder, F.lit("/"), key.cast("string"), F.lit(".png")).alias("path"), stem.alias("name"), F.col("o_custkey").alias("bytes"))
    found = readers.artifacts(files, ["aside"])
    return found.select(F.regexp_replace("file", r"\.png$", "").cast("long").alias("o_orderkey"), "folder", "paper", "number", "bytes")


@query("WITH f AS (SELECT 'n' || (o_custkey % 300) AS name, '/r/' || lpad(o_orderkey::VARCHAR, 9, '0') AS path FROM orders) SELECT name, min(path) AS path FROM f WHERE name IN (SELECT 'n' || (c_custkey % 400) FROM customer WHERE c_nationkey < 9) GROUP BY 1")
def located(spark, d):
    """The first file of each wanted name."""
    files = load(spark, d, "orders", F.concat(F.lit("n"), (F.col("o_custkey") % 300).cast("string")).alias("name"), F.concat(F.lit("/r/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"))
    wanted = load(spark, d, "customer", "c_custkey", "c_nationkey").where("c_nationkey < 9").select(F.concat(F.lit("n"), (F.col("c_custkey") % 400).cast("string")).alias("name"))
    return readers.located(wanted, files)


@query("""
WITH f AS (SELECT DISTINCT 'f' || (o_custkey % 400) || CASE WHEN o_orderkey % 3 = 0 THEN ' (1)' ELSE '' END AS name FROM orders),
k AS (SELECT name, '/r/' || name AS path FROM f a WHERE name NOT LIKE '% (1)' OR NOT EXISTS (SELECT 1 FROM f b WHERE b.name = replace(a.name, ' (1)', '')))
SELECT name, path FROM k WHERE name NOT IN (SELECT 'f' || c_custkey FROM customer WHERE c_custkey % 2 = 0) ORDER BY path LIMIT 120
""")
def working_files(spark, d):
    """The first files still to do: no second downloads, none done."""
    name = F.concat(F.lit("f"), (F.col("o_custkey") % 400).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, " (1)").otherwise(""))
    files = load(spark, d, "orders", "o_custkey", "o_orderkey").select(name.alias("name")).distinct().withColumn("path", F.concat(F.lit("/r/"), F.col("name")))
    done = load(spark, d, "customer", "c_custkey").where("c_custkey % 2 = 0").select(F.concat(F.lit("/r/f"), F.col("c_custkey").cast("string")).alias("path"))
    return readers.working_files(files, done, 120)


LOG_SQL = "WITH l AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS turn, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey DESC) AS rn FROM orders), one AS (SELECT * FROM l WHERE rn = 1), last AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY turn DESC) AS r2 FROM one) "


def _log(spark, d) -> str:
    """A log written in three turns, a row for each customer and turn; later turns have fewer bytes and more files."""
    path = shared_path(spark, "log")
    orders = load(spark, d, "orders", "o_custkey", "o_orderkey").withColumn("turn", (F.col("o_orderkey") % 3).cast("int"))
    once = relations.last_by(orders, ["o_custkey", "turn"], "o_orderkey")
    for turn in range(3):
        rows = once.where(F.col("turn") == turn).select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("paper"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("name"), F.when(F.col("turn") == 1, "ok").otherwise("error" + "!" * (40 - 20 * turn)).alias("status"), F.col("o_orderkey").cast("int").alias("questions"))
        sinks.append_log(rows.repartition(turn + 1), path)
    return path


@query(LOG_SQL + "SELECT 'p' || o_custkey AS paper, turn::INTEGER AS turn, o_orderkey::INTEGER AS questions FROM last WHERE r2 = 1")
def log_latest(spark, d):
    """The last written row of each paper in a log of three commits."""
    rows = readers.log_lines(spark, _log(spark, d), schemas.BATCH_LOG, "paper", strict=True)
    turn = F.when(F.col("status") == "ok", 1).when(F.length("status") == 5, 2).otherwise(0)
    return rows.select("paper", turn.alias("turn"), "questions")


@query(LOG_SQL + "SELECT 'n' || o_custkey AS name, o_orderkey::INTEGER AS questions FROM one WHERE turn = 1")
def log_stream(spark, d):
    """The papers that a log's files finish, followed as a stream to its end."""
    path = shared_path(spark, "finished")
    rows = logs.finished(logs.follow(spark, _log(spark, d)).select("name", "status", "questions"))
    run = logs.process(rows.select("name", "questions"), lambda batch, _: batch.write.mode("append").parquet(path), once=True)
    run.awaitTermination()
    return spark.read.schema("name string, questions int").parquet(path)


@query(LOG_SQL + "SELECT 'n' || o_custkey AS name, 1::BIGINT AS times, max(o_orderkey)::INTEGER AS questions FROM one WHERE turn = 1 GROUP BY 1")
def log_followed(spark, d):
    """Finished papers handed over once each: by a run over what is there, and one that goes on, with rows that come again, to the end marker."""
    log = _log(spark, d)
    own, state, marker = (shared_path(spark, x) for x in ("own", "state", "marker"))

    def follow(**more) -> None:
        logs.follow_log(spark, log, own, lambda work: work.select("name", "questions"), state, **more)

    follow(once=True)
    again = spark.read.schema("paper string, name string, status string, questions int").json(log)
    sinks.append_log(again.withColumn("questions", F.lit(0)), log)
    spark.range(1).select(F.lit("... batch finished\n").alias("value")).write.text(marker)
    follow(marker=marker, every=1)
    return spark.read.schema("name string, questions int").json(own).groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.max("questions").alias("questions"))


@query("SELECT '/r/' || c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def resume(spark, d):
    """Files that the log does not have."""
    files = load(spark, d, "customer", F.concat(F.lit("/r/"), F.col("c_custkey").cast("string")).alias("path"))
    return logs.resume(files, load(spark, d, "orders", F.concat(F.lit("/r/"), F.col("o_custkey").cast("string")).alias("paper")))


@query("SELECT p_name AS q_filename, regexp_replace(trim(p_name), '_(Q|MS)\\.png$', '', 'i') AS stem, p_brand AS subject FROM (SELECT 's' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_q.PNG' ELSE '_MS.png' END AS p_name, p_brand FROM part)")
def catalog_file(spark, d):
    """A catalogue written, sorted, and read back with the stems of its pictures."""
    path = shared_path(spark, "catalog")
    name = F.concat(F.lit("s"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "_q.PNG").otherwise("_MS.png"))
    rows = load(spark, d, "part", "p_partkey", "p_brand").select(F.col("p_brand").alias("subject"), name.alias("q_filename"))
    sinks.write_catalog(rows.select("*", *(F.lit(None).cast("string").alias(c) for c in sinks.CATALOG_COLUMNS if c not in rows.columns)), path)
    return readers.catalog_csv(spark, path).select("q_filename", "stem", "subject")


@query("SELECT DISTINCT unnest(string_split(c_mktsegment || ' ' || c_nationkey, ' ')) AS name FROM customer")
def token_list(spark, d):
    """The words of a written list, each once."""
    path = shared_path(spark, "list")
    lines = load(spark, d, "customer", F.concat_ws("  ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("value"))
    sinks.write_manifest(lines.distinct(), path)
    return readers.tokens(spark, path)


@query("SELECT n_name AS name, len(list(c_custkey))::INTEGER AS n, list_sort(list(c_custkey))[1] AS first_key FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def json_table(spark, d):
    """A JSON table of arrays written and read back."""
    path = shared_path(spark, "json")
    joined = load(spark, d, "customer", "c_custkey", "c_nationkey").join(load(spark, d, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    sinks.rewrite_json(joined.groupBy(F.col("n_name").alias("name")).agg(F.array_sort(F.collect_list("c_custkey")).alias("questions")), path)
    rows = spark.read.schema("name string, questions array<long>").json(path)
    return rows.select("name", F.size("questions").alias("n"), F.get("questions", F.lit(0)).alias("first_key"))


@query("SELECT c_custkey AS customer, c_name AS name, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::INTEGER AS place FROM customer")
def json_document(spark, d):
    """JSON documents that are one array of entries each, a document for each nation, read in the order of their entries."""
    path = shared_path(spark, "documents")
    entries = F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"))))
    texts = load(spark, d, "customer", "c_custkey", "c_name", "c_nationkey").groupBy("c_nationkey").agg(F.to_json(entries).alias("value"))
    texts.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    rows = readers.json_document(spark, f"{path}/c_nationkey=*", "customer long, name string")
    return rows.select("customer", "name", F.row_number().over(Window.partitionBy("ord.file").orderBy("ord")).alias("place"))


@query("SELECT 'Nations: ' || count(*) AS value FROM nation UNION ALL SELECT '' UNION ALL SELECT n_nationkey || ' ' || n_name FROM nation")
def manifest(spark, d):
    """A manifest: its title with a count, an empty line, and a line per row."""
    nations = load(spark, d, "nation", "n_nationkey", "n_name")
    return upsert.manifest(nations, "Nations", F.concat_ws(" ", F.col("n_nationkey").cast("string"), "n_name"), ["n_nationkey"])


@query("SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS file, CASE WHEN l_returnflag = 'A' THEN 'done' ELSE l_linestatus END AS state FROM lineitem WHERE l_returnflag <> 'R'")
def moved(spark, d):
    """Files with the states that a plan gives them; those that go are gone."""
    file = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    lines = load(spark, d, "lineitem", file.alias("file"), F.col("l_linestatus").alias("state"), "l_returnflag")
    plan = lines.where("l_returnflag <> 'N'").select("file", F.when(F.col("l_returnflag") == "A", "done").alias("state"))
    return upsert.moved(lines.select("file", "state"), plan)


@query("""
WITH n AS (SELECT 'x' || (o_custkey % 500) || CASE WHEN o_orderkey % 4 = 0 THEN '-' || (2 + o_orderkey % 5) ELSE '' END AS name FROM orders), taken AS (SELECT DISTINCT name FROM n WHERE hash(name) IS NOT NULL),
used AS (SELECT DISTINCT regexp_replace(name, '-[0-9]+$', '') AS base, coalesce(try_cast(regexp_extract(name, '-([0-9]+)$', 1) AS INTEGER), 1) AS k FROM taken UNION SELECT name, 1 FROM taken),
new AS (SELECT 'x' || (c_custkey % 600) AS name, c_custkey, row_number() OVER (PARTITION BY c_custkey % 600 ORDER BY c_custkey) AS rk FROM customer),
open AS (SELECT new.name, c_custkey, rk, g.k, row_number() OVER (PARTITION BY c_custkey ORDER BY g.k) AS o FROM new CROSS JOIN (SELECT unnest(range(1, 40)) AS k) g WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.base = new.name AND u.k = g.k))
SELECT c_custkey, CASE WHEN k = 1 THEN name ELSE name || '-' || k END AS free FROM open WHERE o = rk
""")
def next_free(spark, d):
    """Names with the first suffix that is not taken."""
    key = F.col("o_orderkey")
    taken = load(spark, d, "orders", "o_custkey", "o_orderkey").select(F.concat(F.lit("x"), (F.col("o_custkey") % 500).cast("string"), F.when(key % 4 == 0, F.concat(F.lit("-"), (key % 5 + 2).cast("string"))).otherwise("")).alias("name")).distinct()
    new = load(spark, d, "customer", "c_custkey").withColumn("name", F.concat(F.lit("x"), (F.col("c_custkey") % 600).cast("string")))
    return sequences.next_free(new, taken, "name", ["c_custkey"]).select("c_custkey", "free")


@query("""
SELECT p_partkey, regexp_replace(lower(p_name || ' No. ' || p_brand), '[^a-z0-9]', '', 'g') AS heading, CASE p_size % 3 WHEN 0 THEN 'Maths' WHEN 1 THEN 'Physics' ELSE '2' END AS subject,
  replace('9702_s25_' || CASE WHEN p_size % 2 = 0 THEN 'ms' ELSE 'er' END || '_' || p_size, '_ms_', '_qp_') AS question_file FROM part
""")
def names_and_headings(spark, d):
    """Look-up keys of headings, labels of subject codes, and names of question files."""
    side = F.concat(F.lit("9702_s25_"), F.when(F.col("p_size") % 2 == 0, "ms").otherwise("er"), F.lit("_"), F.col("p_size").cast("string"))
    subject = names.subject_label((F.col("p_size") % 3).cast("string"), {"0": "Maths", "1": "Physics"})
    return load(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size").select("p_partkey", strings.heading_key(F.concat(F.col("p_name"), F.lit(" No. "), F.col("p_brand"))).alias("heading"), subject.alias("subject"), names.question_side(side).alias("question_file"))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN l_quantity::INTEGER || '(a)' WHEN 2 THEN '(b) text' WHEN 3 THEN 'Question ' || l_quantity::INTEGER || ' on' WHEN 4 THEN l_quantity::INTEGER || '. x' ELSE 'plain' END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_matches(s, '^[0-9]{1,2}\\s*(?:[.(]|$)') AS opens, regexp_matches(s, '^[0-9]{1,2}\\s*\\(') AS part, try_cast(regexp_extract(s, '^Question\\s+([0-9]{1,2})\\b', 1) AS INTEGER) AS heading,
  nullif(regexp_extract(s, '^(?:([0-9]{1,2})\\s*)?\\(([a-z])\\)', 2), '') AS letter FROM t
""")
def label_predicates(spark, d):
    """What texts open as: labels, parts, headings in words."""
    n, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    text = F.when(k == 1, F.concat(n, F.lit("(a)"))).when(k == 2, "(b) text").when(k == 3, F.concat(F.lit("Question "), n, F.lit(" on"))).when(k == 4, F.concat(n, F.lit(". x"))).otherwise("plain")
    lines = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", strings.opens_as_label(text).alias("opens"), strings.names_a_part(text).alias("part"), strings.heading_number(text).alias("heading"), strings.part_label(text)["part"].alias("letter"))


@query("""
WITH f AS (SELECT o_orderkey, 'physics_p' || (o_orderkey % 7 + 1) || (o_custkey % 10) || '_c' || (o_orderkey % 3) || '_2019mj_q' || (o_custkey % 40) AS stem, (o_orderkey % 7 + 1)::VARCHAR AS paper, o_custkey AS marks, o_orderkey % 5 = 0 AS bad FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY o_orderkey DESC) AS rn FROM f WHERE NOT bad), old AS (SELECT DISTINCT stem FROM f WHERE o_orderkey % 3 = 0)
SELECT coalesce(l.stem, old.stem) AS stem, CASE WHEN l.stem IS NULL THEN 'old' ELSE 'physics' END AS subject, l.paper, l.marks::VARCHAR AS marks, CASE WHEN l.stem IS NOT NULL THEN l.stem || '_Q.png' END AS q_filename FROM (SELECT * FROM l WHERE rn = 1) l FULL JOIN old ON l.stem = old.stem
""")
def catalog_export(spark, d):
    """The catalogue after all sound forms are merged in."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    forms = load(spark, d, "orders", "o_orderkey", "o_custkey").select(
        F.lit("Physics").alias("subject"), (key % 7 + 1).cast("string").alias("paper"), (cust % 10).cast("string").alias("variant"), F.concat(F.lit("C"), (key % 3).cast("string")).alias("chapter"), F.when(key % 5 == 0, "19").otherwise("2019").alias("year"),
        F.lit("MJ").alias("season"), (cust % 40).cast("string").alias("question"), F.lit("Q").alias("kind"), F.lit(None).cast("string").alias("subtopic"), F.lit(None).cast("string").alias("difficulty"), cust.cast("string").alias("marks"), F.lit(None).cast("string").alias("youtube_url"), key.alias("seq"),
    )
    named = catalog.checked(forms.withColumn("year", F.lit("2019")))
    old = named.where("seq % 3 = 0").select("stem").distinct().select("stem", F.lit("old").alias("subject"), *(F.lit(None).cast("string").alias(c) for c in sinks.CATALOG_COLUMNS if c != "subject"))
    return catalog.export(forms, old).select("stem", "subject", "paper", "marks", "q_filename")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 600 > 0 THEN 100.0 * (o_orderkey % 600 - o_custkey % 300) / (o_orderkey % 600) ELSE 0.0 END::DOUBLE AS saved,
  CASE o_custkey % 4 WHEN 1 THEN 800 - (o_orderkey % 90 + 9) WHEN 2 THEN 600 - (o_orderkey % 50 + 7) WHEN 3 THEN o_orderkey % 90 ELSE o_orderkey % 50 END::DOUBLE AS x0,
  CASE WHEN o_custkey % 700 IN (0, 500) OR o_custkey % 700 > 500 THEN 500 ELSE o_custkey % 700 END::INTEGER AS wide FROM orders
""")
def page_geometry(spark, d):
    """Shares saved, rectangles as turned pages show them, and widths after fitting."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    x0, y0 = (key % 50).cast("double"), (key % 90).cast("double")
    rect = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 7).alias("x1"), (y0 + 9).alias("y1"))
    shown = numbers.as_shown(rect, F.lit(600.0), F.lit(800.0), cust % 4 * 90)
    wide = numbers.target_size(F.lit(500), F.lit(900), (cust % 700).cast("int"))
    return load(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", numbers.saved_percent((key % 600).cast("double"), (cust % 300).cast("double")).alias("saved"), shown["x0"].alias("x0"), wide["width"].alias("wide"))


@query("SELECT fault, count(*) AS n FROM (SELECT unnest(faults) AS fault FROM f) GROUP BY 1 ORDER BY n DESC, fault LIMIT 3".join([FAULTS_SQL, ""]))
def top_faults(spark, d):
    """The three commonest faults."""
    rows = _faults(load(spark, d, "documents", "doc_id", "n_chars", "lang", "text"))
    return aggregates.counts_by(rows.select(F.explode("faults").alias("fault")), "fault").limit(3)


@query("SELECT l_orderkey, max_by(l_linenumber, (l_quantity, l_tax, -l_linenumber::BIGINT * 1000000000 - l_partkey)) AS line FROM lineitem GROUP BY 1")
def best_by_score(spark, d):
    """The line of each order with the highest score, field by field; of equals the first."""
    lines = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax").withColumn("seq", F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey"))
    return aggregates.best_by(lines, ["l_orderkey"], [F.col("l_quantity"), F.col("l_tax")], "seq", F.col("l_linenumber").alias("line"))


PIXELS = "WITH m AS (SELECT label::VARCHAR AS img, label % 5 AS kind, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS y, list_transform(embedding, lambda x: (floor(x * 255) % 256 + 256) % 256) AS px FROM embeddings)"


def _pixels(spark, d) -> DataFrame:
    """Images whose lines are vectors: img, kind, y, px (bytes)."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    px = F.transform(grey_levels("embedding"), lambda v: F.lpad(F.hex(v), 2, "0"))
    rows = load(spark, d, "embeddings", "vec_id", "label", "embedding")
    return rows.select(F.col("label").cast("string").alias("img"), (F.col("label") % 5).alias("kind"), place.alias("y"), F.unhex(F.array_join(px, "")).alias("px"))


@query(PIXELS + "SELECT img, y, array_to_string(list_transform(px, lambda v: printf('%02X', v::INTEGER)), '') AS line FROM m")
def image_files(spark, d):
    """Grey images written as PNG files and read again: the pixels of every line."""
    path = shared_path(spark, "images")
    sinks.write_png(_pixels(spark, d), path)
    return png.greys(readers.png_lines(spark, path)).select("img", "y", F.hex("px").alias("line"))


@query(PIXELS + """,
k AS (SELECT *, [0, 2, 6, 0, 3][kind + 1] AS colour, [8, 8, 8, 16, 8][kind + 1] AS depth, [64, 21, 16, 32, 64][kind + 1] AS width FROM m)
SELECT img, y, width::INTEGER AS width, colour::INTEGER AS colour, depth::INTEGER AS depth, array_to_string(list_transform(px[1:CASE WHEN colour = 2 THEN 63 ELSE 64 END], lambda v: printf('%02X', v::INTEGER)), '') AS line FROM k
""")
def image_kinds(spark, d):
    """Images of grey, colour, transparency, sixteen bits and palettes, written and read again as they are stored."""
    path = shared_path(spark, "images")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), F.col("kind") + 1).cast("int")
    size = F.max("y").over(Window.partitionBy("img")) + 1
    rows = _pixels(spark, d).withColumns({"colour": pick(0, 2, 6, 0, 3), "depth": pick(8, 8, 8, 16, 8), "width": pick(64, 21, 16, 32, 64), "height": size.cast("int"), "alpha": F.lit(None).cast("binary")})
    rows = rows.withColumn("palette", F.when(F.col("colour") == 3, F.unhex(F.repeat(F.lit("102030"), 256)))).withColumn("line", F.substring("px", F.lit(1), F.when(F.col("colour") == 2, 63).otherwise(64)))
    sinks.write_png(rows, path)
    return readers.png_lines(spark, path).select("img", "y", "width", "colour", "depth", F.hex("line").alias("line"))


BOOKS = """
WITH c AS (SELECT c_nationkey, c_custkey, c_name, (1 + c_nationkey % 3)::INTEGER AS head, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
b AS (SELECT 'n' || c_nationkey AS book, c_nationkey, (head + k)::INTEGER AS row, c_custkey, c_name FROM c)
"""


def _books(spark, d) -> DataFrame:
    """Cells of a workbook for each nation: headings, a row for each customer, and a column of formulas."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = load(spark, d, "customer", "c_custkey", "c_nationkey", "c_name").withColumns({"k": place, "head": F.col("c_nationkey") % 3 + 1})
    none = F.lit(None).cast("string")

    def cell(row, col: int, kind: str, value, formula=none, style: int | None = None):
        return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), formula.alias("formula"), F.lit(style).cast("int").alias("style"))

    row = F.col("head") + F.col("k")
    heads = [cell(F.col("head"), col, "text", F.lit(name)) for col, name in ((2, "Subject"), (3, "Q file name"), (5, "Topic"), (6, "Marks"), (10, "Auto"))]
    body = [cell(row, 3, "text", F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit("_Q.png"))), cell(row, 5, "text", F.col("c_name")), cell(row, 6, "number", F.col("c_custkey") % 20), cell(row, 10, "number", none, F.concat(F.lit("C"), row.cast("string"), F.lit('&$B$1&"C1"')))]
    cells = rows.select("c_nationkey", F.explode(F.array(*body)).alias("x")).unionByName(rows.where("k = 1").select("c_nationkey", F.explode(F.array(*heads)).alias("x")))
    return cells.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("book"), F.lit("Questions").alias("sheet"), "x.*")


@query(BOOKS + """SELECT book, row, 3 AS col, 's' || c_custkey || '_Q.png' AS value, NULL AS formula FROM b UNION ALL SELECT book, row, 5, c_name, NULL FROM b
UNION ALL SELECT book, row, 6, (c_custkey % 20)::VARCHAR, NULL FROM b UNION ALL SELECT book, row, 10, NULL, 'C' || row || '&$B$1&"C1"' FROM b
UNION ALL SELECT DISTINCT 'n' || c_nationkey, head, h.col, h.name, NULL FROM c, (VALUES (2, 'Subject'), (3, 'Q file name'), (5, 'Topic'), (6, 'Marks'), (10, 'Auto')) h(col, name)""")
def workbook_cells(spark, d):
    """Workbooks written and read again, cell by cell."""
    path = shared_path(spark, "books")
    sinks.write_cells(_books(spark, d), path)
    return readers.cells(spark, path).where("row > 0").select("book", "row", "col", "value", "formula")


@query(BOOKS + """,
e AS (SELECT 'n' || o_custkey % 25 AS book, o_custkey, min(o_orderkey) AS seq, arg_max(o_orderkey % 9, o_orderkey) FILTER (o_orderkey % 9 > 0) AS marks FROM orders GROUP BY 1, 2),
l AS (SELECT book, max(row) AS last FROM b GROUP BY 1),
p AS (SELECT e.*, b.row AS old, last FROM e JOIN l USING (book) LEFT JOIN b ON b.book = e.book AND b.c_custkey = e.o_custkey),
n AS (SELECT *, coalesce(old, last + row_number() OVER (PARTITION BY book, old IS NULL ORDER BY seq))::INTEGER AS row FROM p)
SELECT coalesce(b.book, n.book) AS book, coalesce(b.row, n.row) AS row, coalesce('s' || n.o_custkey || '_q.PNG', 's' || b.c_custkey || '_Q.png') AS q_filename, coalesce(n.marks, b.c_custkey % 20)::VARCHAR AS marks, 'C' || coalesce(b.row, n.row) || '&$B$1&"C1"' AS formula
FROM b FULL JOIN n ON n.book = b.book AND n.row = b.row
""")
def workbook_entries(spark, d):
    """Entries put in their workbooks: rows that have their stem, new rows below with the formula carried down, blanks that write nothing."""
    base, path = shared_path(spark, "books"), shared_path(spark, "books")
    sinks.write_cells(_books(spark, d), base)
    key = F.col("o_custkey").cast("string")
    marks = F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey") % 9)
    entries = load(spark, d, "orders", "o_orderkey", "o_custkey").select(F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string")).alias("book"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("s"), key, F.lit("_q.PNG")).alias("q_filename"), marks.alias("marks"), F.lit("").alias("chapter"))
    updates, _ = workbook.additions(readers.cells(spark, base), entries)
    sinks.write_cells(updates, path, base)
    done = materialize(readers.cells(spark, path).where("row > 0"), "cells")  # workbooks are slow to read, and four steps do
    rows = readers.sheet_rows(done.withColumn("sheet", F.col("book"))).select(F.col("sheet").alias("book"), "row", "q_filename", "marks")
    return rows.join(done.where("formula is not null").select("book", "row", "formula"), ["book", "row"], "left")

