"""Registered queries of page layout, item starts and images, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions import numbers
from quiresmith.operators import bands, canvas, layout, raster, sequences, starts
from quiresmith.plans import corpus
from quiresmith.plans.registry import grey_levels, query
from quiresmith.session import load, materialize

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _lines(spark, d, *more: str) -> DataFrame:
    """Lines of orders with ``k``, their place in the order (from 0)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return load(spark, d, "lineitem", *LINE, *more).withColumn("k", F.row_number().over(order) - 1)


LINES = "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM lineitem)"


def _pick(of: Column, *texts: str) -> Column:
    """One of the texts, by the remainder of a number."""
    return F.get(F.array(*map(F.lit, texts)), F.pmod(of, F.lit(len(texts))).cast("int"))


def _picked(of: str, *texts: str) -> str:
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"[{quoted}][{of} % {len(texts)} + 1]"


PAGE_TEXTS = ("1 State the law. [3]", "a line ............ of dots", "Question Answer  Marks", "BLANK PAGE", "additional page", "Data Booklet", "the PERIODIC table of Elements", "Permission to reproduce items", "plain words", "[Total: 12] end")


@query(LINES + f""", p AS (SELECT l_orderkey AS doc, k AS page, {_picked('(l_partkey + l_suppkey)', *PAGE_TEXTS)} AS text FROM l),
m AS (SELECT *, regexp_matches(lower(text), 'the periodic table of elements|permission to reproduce items|blank page|additional page|data booklet') AS e, regexp_matches(text, '\\[(Total: )?[0-9]+\\]') AS marked FROM p),
t AS (SELECT *, min(e::INTEGER) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 1 AS tail FROM m)
SELECT doc::VARCHAR AS doc, coalesce(min(page) FILTER (text LIKE '%....%'), 0)::INTEGER AS first_question, (min(page) FILTER (text LIKE 'Question Answer%'))::INTEGER AS answer_page,
  greatest(coalesce(max(page + 1) FILTER (NOT tail), 1), coalesce(max(page + 1) FILTER (marked), 0), 1)::INTEGER AS last_page, CASE WHEN count_if(text LIKE 'Question Answer%') > 0 THEN 'ms' ELSE 'qp' END AS kind FROM t GROUP BY doc
""")
def content_pages(spark, d):
    """First question page, answer page, end of the content and kind, from the texts of pages."""
    texts = _lines(spark, d).select(F.col("l_orderkey").cast("string").alias("doc"), F.col("k").alias("page"), _pick(F.col("l_partkey") + F.col("l_suppkey"), *PAGE_TEXTS).alias("text"))
    return layout.document_facts(texts).select("doc", "first_question", "answer_page", "last_page", "kind")


@query(LINES + f""", p AS (SELECT l_orderkey AS doc, k AS page, {_picked('(l_partkey + l_suppkey)', *PAGE_TEXTS)} AS text FROM l), a AS (SELECT doc, min(page) AS begins FROM p WHERE text LIKE 'Question Answer%' GROUP BY 1)
SELECT doc::VARCHAR AS doc, page::INTEGER AS page FROM p LEFT JOIN a USING (doc) WHERE page >= coalesce(begins, 0)
""")
def after_preamble(spark, d):
    """Spans from the answer page on."""
    texts = _lines(spark, d).select(F.col("l_orderkey").cast("string").alias("doc"), F.col("k").alias("page"), _pick(F.col("l_partkey") + F.col("l_suppkey"), *PAGE_TEXTS).alias("text"))
    return layout.after_preamble(texts, layout.document_facts(texts)).select("doc", "page")


#: A block for every rule: (text, x0, y0, x1, y1), on pages of 600 by 800.
RULED = (
    ("DO NOT WRITE HERE", 100, 300, 200, 320), ("word", 2, 200, 20, 400), ("\x01" * 12, 100, 300, 200, 320), ("*12 34*", 100, 300, 200, 320), ("see Turn over now", 100, 300, 200, 320), ("Section B", 100, 300, 200, 320), ("Cambridge International", 100, 20, 300, 40),
    ("Mark Scheme for 9702", 100, 300, 200, 320), ("PUBLISHED", 100, 60, 200, 80), ("Question Marks", 100, 300, 200, 320), ("a copyright acknowledgement", 100, 300, 200, 320), ("last words", 100, 760, 200, 790), ("17", 290, 20, 310, 40), ("2 (a) State the law.", 100, 300, 200, 320), ("  ", 100, 760, 200, 790),
)
RULES = ("margin phrase", "edge bar", "code strip", "starred digits", "phrase", "navigation", "running line", "banner", "published", "column heading", "notice", "foot", "page number", None, None)
_CASES = " ".join(f"WHEN {k} THEN {'NULL' if r is None else repr(r)}" for k, r in enumerate(RULES))


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(RULES)} {_CASES} END AS rule FROM orders")
def furniture_rules(spark, d):
    """The first rule that makes a block furniture, over blocks for every rule."""
    block = F.get(F.array(*(F.struct(F.lit(t).alias("text"), *(F.lit(float(v)).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), box))) for t, *box in RULED)), (F.col("o_orderkey") % len(RULED)).cast("int"))
    blocks = load(spark, d, "orders", "o_orderkey").withColumn("b", block)
    return blocks.select("o_orderkey", layout.furniture_rule(*(F.col(f"b.{c}") for c in ("text", "x0", "y0", "x1", "y1")), F.lit(600.0), F.lit(800.0)).alias("rule"))


TAILS = ("Important values, constants", "Important  value constants", "the periodic\ntable of elements", "Copyright Acknowledgements", "To avoid the issue of disclosure of answer-related information", "The boundaries and names shown, the designations used", "2 (b) plain")


@query(LINES + f""", b AS (SELECT l_orderkey AS doc, 150 + 30 * k AS y0, {_picked('l_partkey', "Important values, constants and standards", "Important values constants", *TAILS[2:])} AS text, l_partkey % 7 IN (0, 2, 3, 4, 5) AS tail FROM l)
SELECT doc::VARCHAR AS doc, (min(y0) FILTER (tail) - 2)::DOUBLE AS top FROM b GROUP BY 1 HAVING count_if(tail) > 0
""")
def tail_matter(spark, d):
    """Where reference matter is cut off below the last item."""
    text = _pick(F.col("l_partkey"), "Important values, constants and standards", "Important values constants", *TAILS[2:])
    blocks = _lines(spark, d).select(F.col("l_orderkey").cast("string").alias("doc"), F.lit(0).alias("page"), text.alias("text"), F.lit(50.0).alias("x0"), (F.col("k") * 30 + 150.0).alias("y0"), F.lit(300.0).alias("x1"), (F.col("k") * 30 + 162.0).alias("y1"))
    pages = blocks.select("doc", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    bands = blocks.select("doc").distinct().withColumns({"head": F.lit(0.0), "foot": F.lit(0.0)})
    return layout.redactions(blocks, pages, bands).where("x0 = 0 and x1 = 600").select("doc", F.col("y0").alias("top"))


@query(LINES + """, h AS (SELECT l_orderkey AS doc, k AS page, l_partkey % 3 * 10 + 40 AS y1 FROM l WHERE l_suppkey % 4 > 0), n AS (SELECT doc, y1, count(*) AS n FROM h GROUP BY 1, 2)
SELECT o.doc::VARCHAR AS doc, coalesce(max(y1) FILTER (n >= 2), 0)::DOUBLE AS head FROM (SELECT DISTINCT l_orderkey AS doc FROM l) o LEFT JOIN n USING (doc) GROUP BY 1
""")
def header_bands(spark, d):
    """How deep the headers go that pages of a document agree on."""
    lines = _lines(spark, d).withColumn("doc", F.col("l_orderkey").cast("string"))
    blocks = lines.where("l_suppkey % 4 > 0").select("doc", F.col("k").alias("page"), F.lit("Cambridge International").alias("text"), F.lit(50.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(300.0).alias("x1"), (F.col("l_partkey") % 3 * 10 + 40.2).alias("y1"))
    pages = lines.select("doc", F.col("k").alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return layout.header_footer_bands(blocks, pages).select("doc", "head")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 900 > 18 AND o_custkey % 900 < 882 AND NOT (o_custkey % 900 - 0.5 < 300 AND o_custkey % 900 + 0.5 > 100 AND o_orderkey % 400 < 200)")
def swept_spans(spark, d):
    """Spans in the body that no swept area touches."""
    from quiresmith.plans.documents import swept_spans as swept

    spans = load(spark, d, "orders", "o_orderkey", (F.col("o_custkey") % 900).cast("double").alias("y"), (F.col("o_orderkey") % 400).cast("double").alias("left")).withColumns({"doc": F.lit("d"), "page": F.lit(0), "centre": F.col("left") + 20})
    areas = spark.range(1).select(F.lit("d").alias("doc"), F.lit(0).alias("page"), F.lit(0.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(300.0).alias("y1"))
    pages = spark.range(1).select(F.lit("d").alias("doc"), F.lit(0).alias("page"), F.lit(900.0).alias("height"))
    return layout.body_spans(swept(spans, areas), pages).select("o_orderkey")


@query(LINES + """, p AS (SELECT l_orderkey, l_linenumber % 2 AS line, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, chr((97 + l_partkey % 3)::INTEGER) AS c FROM l)
SELECT l_orderkey::VARCHAR AS doc, line::BIGINT AS line, string_agg('mid' || c || 'end', ' ' ORDER BY n) AS text FROM p GROUP BY 1, 2
""")
def mended_lines(spark, d):
    """Lines whose words are broken over boxes that overlap, stitched."""
    w = Window.partitionBy("l_orderkey", F.col("l_linenumber") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = _lines(spark, d).withColumns({"n": F.row_number().over(w), "c": F.char(F.col("l_partkey") % 3 + 97)})
    halves = F.array(F.struct(F.lit(0.0).alias("at"), F.lit(6.0).alias("wide"), F.concat(F.lit("mid"), F.col("c"), F.lit("e")).alias("text")), F.struct(F.lit(4.0).alias("at"), F.lit(6.0).alias("wide"), F.concat(F.col("c"), F.lit("end")).alias("text")))
    pieces = lines.select("l_orderkey", "l_linenumber", "n", F.explode(halves).alias("h"))
    pieces = pieces.select(F.col("l_orderkey").cast("string").alias("doc"), F.lit(0).alias("page"), (F.col("n") * 20 + F.col("h.at")).alias("x0"), (F.col("n") * 20 + F.col("h.at") + F.col("h.wide")).alias("x1"), (F.col("l_linenumber") % 2 * 3.0).alias("y"), "h.text")
    return layout.mended_lines(pieces).select("doc", "line", "text")


@query(LINES + """, b AS (SELECT l_orderkey AS doc, 20 + l_partkey % 400 AS x0, 20 + l_suppkey % 700 AS y0, 20 + l_partkey % 400 + l_linenumber * 30 AS x1, 20 + l_suppkey % 700 + l_linenumber * 20 AS y1 FROM l),
c AS (SELECT *, x1 > 50 AND x0 < 550 AND y1 > 60 AND y0 < 740 AS inside FROM b)
SELECT doc::VARCHAR AS doc, greatest(0, least(50, coalesce(min(x0 - 1) FILTER (inside AND x0 < 50), 50)))::DOUBLE AS "left", greatest(0, least(60, coalesce(min(y0 - 1) FILTER (inside AND y0 < 60), 60)))::DOUBLE AS top,
  least(600, greatest(550, coalesce(max(x1 + 1) FILTER (inside AND x1 > 550), 550)))::DOUBLE AS "right", least(800, greatest(740, coalesce(max(y1 + 1) FILTER (inside AND y1 > 740), 740)))::DOUBLE AS foot FROM c GROUP BY 1
""")
def page_windows(spark, d):
    """Windows of pages, grown so that they cut no block."""
    x0, y0 = (F.col("l_partkey") % 400 + 20).cast("double"), (F.col("l_suppkey") % 700 + 20).cast("double")
    blocks = _lines(spark, d).select(F.col("l_orderkey").cast("string").alias("doc"), F.lit(0).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_linenumber") * 30).alias("x1"), (y0 + F.col("l_linenumber") * 20).alias("y1"))
    pages = blocks.select("doc", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    return layout.page_windows(blocks, pages, {"left": 50, "top": 60, "right": 50, "bottom": 60}).select("doc", "left", "top", "right", "foot")


@query("SELECT p_brand AS doc, count(*) >= 20 AND count_if(length(p_name) <= 6 OR p_size % 3 > 0) > 0.5 * count(*) AS shredded FROM part GROUP BY 1")
def shredded(spark, d):
    """Documents whose text comes in pieces."""
    text = F.when(F.col("p_size") % 3 > 0, " Que ").otherwise(F.col("p_name"))
    return layout.shredded(load(spark, d, "part", F.col("p_brand").alias("doc"), text.alias("text")))


BANNERS = ("Mark Scheme 9702", "Page 4 of 12", "plain", "words", "Answer:", "Question Answer Mark", "PUBLISHED x")


@query(LINES + f""", p AS (SELECT l_orderkey AS doc, k AS page, {_picked('l_partkey', *BANNERS)} AS text, l_suppkey % 2 = 0 AS high FROM l),
f AS (SELECT doc, page, CASE text WHEN 'Mark Scheme 9702' THEN 'Mark Scheme' WHEN 'Page 4 of 12' THEN 'Page 4 of 12' WHEN 'Question Answer Mark' THEN 'Question Answer Mark' WHEN 'PUBLISHED x' THEN 'PUBLISHED' WHEN 'Answer:' THEN CASE WHEN high THEN 'answer' END END AS text FROM p)
SELECT doc::VARCHAR AS doc, min(page)::INTEGER AS page, min_by(text, page) AS text FROM f WHERE text IS NOT NULL GROUP BY 1
""")
def left_furniture(spark, d):
    """The first page of each document that still bears a banner or a lone column word."""
    lines = _lines(spark, d).select(F.col("l_orderkey").cast("string").alias("doc"), F.col("k").alias("page"), _pick(F.col("l_partkey"), *BANNERS).alias("text"), F.when(F.col("l_suppkey") % 2 == 0, 100.0).otherwise(400.0).alias("y0"))
    pages = lines.select("doc", "page").withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    return layout.left_furniture(lines.select("doc", "page", "text"), lines, pages)


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 30 AS x, l_suppkey % 5 AS n, row_number() OVER (PARTITION BY l_orderkey, round_even((l_partkey % 30) / 4.0::DOUBLE, 0), l_suppkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM s WHERE rn = 1
""")
def first_places(spark, d):
    """The first row of each number in each column bucket."""
    lines = load(spark, d, "lineitem", *LINE).withColumns({"x": F.col("l_partkey") % 30, "n": F.col("l_suppkey") % 5})
    return sequences.first_places(lines, ["l_orderkey"], "x", "n", 4.0, ["l_linenumber", "l_partkey", "l_suppkey"]).select(*LINE)


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 20)::DOUBLE AS x, round_even((l_suppkey % 12) / 3.0::DOUBLE, 0) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x <= min(x) OVER (PARTITION BY l_orderkey, b) + 0.5 AS opens FROM s
""")
def coarse_openings(spark, d):
    """Whether a span is the first in its bucket of lines."""
    spans = load(spark, d, "lineitem", *LINE).withColumns({"left": (F.col("l_partkey") % 20).cast("double"), "y": (F.col("l_suppkey") % 12).cast("double")})
    return sequences.opens_coarse_line(spans, ["l_orderkey"]).select(*LINE, "opens")


@query("""
WITH r AS (SELECT event_id, user_id, ts, greatest(0, value::INTEGER % 50 - 10) AS ink FROM events), n AS (SELECT *, quantile_cont(CASE WHEN ink > 0 THEN ink END, 0.75) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 FOLLOWING AND 15 FOLLOWING) AS near FROM r)
SELECT event_id, coalesce(ink > 0.6 * near, false) AS like_inward FROM n
""")
def like_neighbours(spark, d):
    """Whether a row has the ink of the rows further in."""
    rows = load(spark, d, "events", "event_id", "user_id", "ts", F.greatest(F.lit(0), F.bround("value", 0).cast("int") % 50 - 10).alias("ink"))
    return sequences.like_neighbours(rows, ["user_id"], ["ts", "event_id"], "ink").select("event_id", "like_inward")


def _spans(lines: DataFrame, left: Column, y: Column, text: Column, page: Column | None = None) -> DataFrame:
    return lines.select(F.col("l_orderkey").cast("string").alias("doc"), F.lit("qp").alias("kind"), (F.lit(0) if page is None else page).cast("int").alias("page"), F.col("k").alias("ord"), left.cast("double").alias("left"), (left + 3).cast("double").alias("centre"), y.cast("double").alias("y"), text.alias("text"))


@query(LINES + """, n AS (SELECT l_orderkey AS o, count(*) AS n, l_orderkey % 5 AS r FROM l GROUP BY 1 HAVING count(*) >= 5)
SELECT o::VARCHAR AS doc, (CASE WHEN v <= 3 THEN 0 ELSE 1 END)::INTEGER AS page, (v * 40.0)::DOUBLE AS y, v::INTEGER AS number FROM (SELECT o, r, n, unnest(range(1, n + 1)) AS v FROM n) WHERE NOT (v = 3 AND r = 1) AND NOT (v = n AND r = 3)
""")
def gap_fill(spark, d):
    """Items whose label ran into its wording, in between and past the last; where the wording is out of line or before its neighbours, none.

    Orders of five lines and more are documents of two pages. Item 3 is worded; by the order's key it is missing
    (remainder 1), out of place (2, a second one before item 1), or plain. The last is worded, or out of line (3).
    """
    lines = _lines(spark, d)
    sized = lines.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))).where("n >= 5")
    v, r = F.col("k") + 1, F.col("l_orderkey") % 5
    worded = (v == 3) | (v == F.col("n"))
    text = F.when(worded, F.concat(v.cast("string"), F.lit(" Use the formula"))).otherwise(v.cast("string"))
    left = F.when((v == F.col("n")) & (r == 3), 90).otherwise(50)
    spans = _spans(sized.where(~((v == 3) & (r == 1))), left, v * 40.0, text, F.when(v <= 3, 0).otherwise(1))
    early = _spans(sized.where((r == 2) & (v == 1)), F.lit(50), F.lit(10.0), F.lit("3 before all"), F.lit(0))
    return starts.find_starts(spans.unionByName(early))


@query(LINES + """, n AS (SELECT l_orderkey AS o, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 3)
SELECT o::VARCHAR AS doc, (v - 1)::INTEGER AS page, 100.0::DOUBLE AS y, v::INTEGER AS number FROM (SELECT o, unnest(range(1, n + 1)) AS v FROM n)
""")
def contested_columns(spark, d):
    """Items where several columns count: a longer list on one page, a crooked one, and the margin's, which spans pages."""
    sized = _lines(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))).where("n >= 3")
    v = F.col("k") + 1
    margin = _spans(sized, F.lit(50), F.lit(100.0), v.cast("string"), F.col("k"))
    listed = sized.where("k = 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(9))))
    inner = _spans(listed, F.lit(90), F.col("j") * 20.0 + 150, F.col("j").cast("string"), F.lit(0))
    crooked = _spans(sized, F.lit(70) + F.col("k") % 2 * 3, F.lit(500.0), v.cast("string"), F.col("k"))
    return starts.find_starts(margin.unionByName(inner).unionByName(crooked))


@query(LINES + """, n AS (SELECT l_orderkey AS o, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 2)
SELECT o::VARCHAR AS doc, (v - 1)::INTEGER AS page, (CASE WHEN v % 2 = 0 THEN 100 ELSE 60 END)::DOUBLE AS y, v::INTEGER AS number FROM (SELECT o, unnest(range(1, n + 1)) AS v FROM n)
""")
def snapped_starts(spark, d):
    """Items of answer sides, moved up to the first label with their number, which may stand off the column's left edge."""
    sized = _lines(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))).where("n >= 2")
    v = (F.col("k") + 1).cast("string")
    own = _spans(sized, F.lit(50), F.lit(100.0), F.concat(v, F.lit("(b)")), F.col("k"))
    before = _spans(sized.where("k % 2 = 0"), F.lit(56), F.lit(60.0), F.concat(v, F.lit("(a)")), F.col("k"))
    return starts.find_starts(own.unionByName(before).withColumn("kind", F.lit("ms")))


@query(LINES + """, n AS (SELECT l_orderkey AS o, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 2)
SELECT o::VARCHAR AS doc, 0::INTEGER AS page, (v * 30.0)::DOUBLE AS y, v::INTEGER AS number FROM (SELECT o, unnest(range(1, n + 1)) AS v FROM n WHERE o % 3 > 0)
""")
def worded_headings(spark, d):
    """Items of answer sides by headings in words, where these count from one without a break."""
    sized = _lines(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))).where("n >= 2")
    v = F.col("k") + 1 + F.when((F.col("l_orderkey") % 3 == 0) & (F.col("k") > 0), 1).otherwise(0)
    return starts.find_starts(_spans(sized, F.lit(50), (F.col("k") + 1) * 30.0, F.concat(F.lit("Question "), v.cast("string"), F.lit(" Planning"))).withColumn("kind", F.lit("ms")))


@query(LINES + """, n AS (SELECT l_orderkey AS o, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 3)
SELECT o::VARCHAR AS doc, CASE o % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END::INTEGER AS reading, CASE WHEN o % 4 < 3 THEN 'cut' ELSE 'could not find them all' END AS status, CASE WHEN o % 4 < 3 THEN n ELSE n - 1 END::BIGINT AS found FROM n
""")
def second_readings(spark, d):
    """Orders read three ways: in their own column, along the edge when starts stand elsewhere, and with what the sweep took; some have no last number at all."""
    sized = _lines(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))).where("n >= 3")
    sized = materialize(sized.select("l_orderkey", "k", "n"), "lines")  # six tables are made of it
    way, number = F.col("l_orderkey") % 4, F.col("k") + 1
    raw = _spans(sized.where((way < 3) | (number < F.col("n"))), F.lit(50), number * 40.0, number.cast("string"))
    decoys = _spans(sized.where((way == 1) & (number == 1)), F.lit(163), number * 40.0 + 20.0, number.cast("string"))
    whole = raw.unionByName(decoys)
    swept = whole.where("not (cast(doc as long) % 4 = 2 and text = '1')")
    begun = sized.where((way != 1) | (number == 1)).select(F.col("l_orderkey").cast("string").alias("doc"), F.lit(0).alias("page"), (number * 40.0 + F.when(way == 1, 20.0).otherwise(0.0)).alias("y"), number.cast("int").alias("number"))
    wanted = sized.where("k = 0").select(F.col("l_orderkey").cast("string").alias("doc"), F.sequence(F.lit(1), F.col("n").cast("int")).alias("target"))
    readings, items = corpus.second_reading(swept, whole, wanted, begun)
    return readings.join(items.groupBy("doc").agg(F.count(F.lit(1)).alias("found")), "doc", "left").select("doc", "reading", "status", F.coalesce("found", F.lit(0)).alias("found"))


@query(LINES + """, s AS (SELECT l_orderkey AS doc, 40 + l_partkey % 9 AS x, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY k) AS rn FROM l WHERE NOT l_discount > 0.05)
SELECT doc::VARCHAR AS doc, (min(x) - 6)::DOUBLE AS low, (max(x) + 6)::DOUBLE AS high FROM s WHERE rn = 1 GROUP BY 1
""")
def column_bands(spark, d):
    """Where labels stand from which starts were read."""
    lines = _lines(spark, d, "l_discount")
    spans = _spans(lines, F.col("l_partkey") % 9 + 40, F.col("k") * 20.0, F.col("l_linenumber").cast("string"))
    found = lines.where("not l_discount > 0.05").select(F.col("l_orderkey").cast("string").alias("doc"), F.lit(0).alias("page"), (F.col("k") * 20.0 + 0.2).alias("y"), F.col("l_linenumber").alias("number"))
    return corpus.column_bands(spans, found)


@query(LINES + """, i AS (SELECT l_orderkey AS doc, k, l_partkey % 3 AS p FROM l)
SELECT doc::VARCHAR AS doc, (k + 1)::INTEGER AS number, CASE p WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS first_part FROM i
""")
def interval_parts(spark, d):
    """The first part label inside each item's interval."""
    lines = materialize(_lines(spark, d), "lines")  # four tables are made of it
    labels = _spans(lines, F.lit(50), F.col("k") * 100.0, (F.col("k") + 1).cast("string"))
    parts = _spans(lines.where("l_partkey % 3 < 2"), F.lit(70), F.col("k") * 100.0 + 20, _pick(F.col("l_partkey"), "(a) State", "(b) Find", "x"))
    later = _spans(lines, F.lit(70), F.col("k") * 100.0 + 40, F.when(F.col("l_partkey") % 3 == 2, "plain").otherwise("(c) Explain"))
    found = lines.select(F.col("l_orderkey").cast("string").alias("doc"), F.lit(0).alias("page"), (F.col("k") * 100.0).alias("y"), (F.col("k") + 1).alias("number"))
    return corpus.interval_faults(labels.unionByName(parts).unionByName(later), found).select("doc", "number", "first_part")


def _images(spark, d, threshold: float) -> DataFrame:
    """Images whose rows are vectors: img, y, ink."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return load(spark, d, "embeddings", "vec_id", "label", "embedding").select(F.col("label").cast("string").alias("img"), place.alias("y"), F.transform("embedding", lambda x: x > threshold).alias("ink"))


IMAGES = "WITH m AS (SELECT label::VARCHAR AS img, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS y, list_transform(embedding, lambda x: x > {t}) AS ink FROM embeddings), p AS (SELECT *, len(list_filter(ink, lambda v: v)) AS n FROM m)"


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: (floor(x * 255) % 256 + 256) % 256 < 100)::INTEGER[])::BIGINT AS ink, len(list_filter(embedding, lambda x: (floor(x * 255) % 256 + 256) % 256 >= 225))::INTEGER AS white FROM embeddings")
def ink_and_white(spark, d):
    """Ink pixels, and pixels that whitening makes white."""
    grey = grey_levels("embedding").cast("array<int>")
    rows = load(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", grey.alias("px"))
    ink = F.size(F.filter(raster.ink_mask(F.col("px"), 100), lambda v: v)).cast("long")
    return rows.select("vec_id", ink.alias("ink"), F.size(F.filter(raster.whitened(F.col("px")), lambda v: v == 255)).alias("white"))


@query(IMAGES.format(t=0.42) + "SELECT img, sum(n) < 0.0006 * sum(len(ink)) AS blank FROM p GROUP BY 1")
def blank_images(spark, d):
    """Images with next to no ink."""
    return raster.blank_images(raster.row_profile(_images(spark, d, 0.42)))


@query("WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'N' AS blank, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'N', l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM f WHERE NOT blank OR rn = 1")
def kept_parts(spark, d):
    """Parts that are not blank, or the first where all are."""
    lines = load(spark, d, "lineitem", *LINE, "l_returnflag").withColumns({"blank": F.col("l_returnflag") == "N", "at": F.struct("l_linenumber", "l_partkey", "l_suppkey")})
    return raster.kept_parts(lines, ["l_orderkey"], "at", "blank").select(*LINE)


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS height, l_suppkey % 30 + 1 AS width FROM lineitem), w AS (SELECT *, max(width) OVER (PARTITION BY l_orderkey) AS wide FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, wide::BIGINT AS width, greatest(1, round_even((height * wide)::DOUBLE / width, 0))::INTEGER AS height FROM w
""")
def matched_parts(spark, d):
    """Parts scaled to the widest of their order."""
    lines = load(spark, d, "lineitem", *LINE, "l_quantity")
    parts = lines.select(*LINE, F.col("l_quantity").cast("long").alias("height"), (F.col("l_suppkey") % 30 + 1).alias("width"))
    return raster.matched(parts, ["l_orderkey"]).select(*LINE, "width", "height")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: abs(floor(x * 40)) > 12)) < 0.002 * len(embedding) AS grey FROM embeddings")
def grey_images(spark, d):
    """Whether nearly no pixel has colour."""
    spreads = F.transform("embedding", lambda x: F.abs(F.floor(x * F.lit(40).cast("float"))))
    return load(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", numbers.is_grey(spreads).alias("grey"))


@query("""
WITH RECURSIVE m AS (SELECT label::VARCHAR AS img, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS y, len(list_filter(embedding, lambda x: x > 0.3)) = 0 AS blank FROM embeddings),
t AS (SELECT img, count(*)::INTEGER AS total FROM m GROUP BY 1),
page AS (SELECT img, 0 AS first, (SELECT CASE WHEN t.total <= 40 THEN t.total ELSE coalesce((SELECT max(y) FROM m WHERE m.img = t.img AND blank AND y > 28 AND y < 40), 40) END) AS stop FROM t
  UNION ALL
  SELECT n.img, n.first, CASE WHEN n.first + 40 >= n.total THEN n.total ELSE coalesce((SELECT max(y) FROM m WHERE m.img = n.img AND blank AND y > n.first + 28 AND y < n.first + 40), n.first + 40) END
  FROM (SELECT p.img, t.total, (SELECT min(y) FROM m WHERE m.img = p.img AND NOT blank AND y >= p.stop) AS first FROM page p JOIN t USING (img)) n WHERE n.first IS NOT NULL)
SELECT img, first, stop FROM page
""")
def paginated(spark, d):
    """Tall images cut into pages at blank rows."""
    return bands.pages_of(_images(spark, d, 0.3), 40)


@query(IMAGES.format(t=0.12) + """,
c AS (SELECT img, k, avg(ink[k]::INTEGER) > 0.5 AND count(*) > 20 AS border FROM m, (SELECT unnest(range(1, 65)) AS k) GROUP BY img, k), b AS (SELECT img, list(border ORDER BY k) AS borders FROM c GROUP BY 1),
q AS (SELECT img, y, list_transform(ink, lambda v, i: v AND NOT borders[i]) AS ink FROM m JOIN b USING (img)),
f AS (SELECT img, y, len(list_filter(ink, lambda v: v)) AS n, len(list_filter(ink, lambda v, i: v AND (i = 1 OR NOT ink[i - 1]))) AS pieces FROM q),
g AS (SELECT *, quantile_cont(CASE WHEN n > 0 THEN n END, 0.75) OVER (PARTITION BY img ORDER BY y ROWS BETWEEN 3 FOLLOWING AND 15 FOLLOWING) AS down, quantile_cont(CASE WHEN n > 0 THEN n END, 0.75) OVER (PARTITION BY img ORDER BY y DESC ROWS BETWEEN 3 FOLLOWING AND 15 FOLLOWING) AS up,
   quantile_cont(CASE WHEN n > 0 THEN n END, 0.98) OVER (PARTITION BY img) AS line FROM f),
e AS (SELECT img, y, n, CASE WHEN pieces BETWEEN 10 AND 150 AND n / line >= 0.8 AND n > 0.6 * down THEN n / line ELSE 0 END AS top, CASE WHEN pieces BETWEEN 10 AND 150 AND n / line >= 0.8 AND n > 0.6 * up THEN n / line ELSE 0 END AS foot FROM g WHERE n > 0)
SELECT img, min_by(top, y)::DOUBLE AS top, (CASE WHEN count(*) = 1 THEN min_by(top, y) ELSE max_by(foot, y) END)::DOUBLE AS foot FROM e GROUP BY 1
""")
def cut_edges(spark, d):
    """How far first and last rows of images look cut."""
    return bands.cut_edges(_images(spark, d, 0.12))


def _greys(spark, d) -> DataFrame:
    """Grey images whose rows are vectors: img, y, px; every ninth row is a dotted ruling."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = load(spark, d, "embeddings", "vec_id", "label", "embedding").select(F.col("label").cast("string").alias("img"), place.alias("y"), "embedding")
    dotted = F.transform("embedding", lambda x, k: F.when(k % 2 == 0, 0).otherwise(255))
    return rows.select("img", "y", F.when(F.col("y") % 9 == 4, dotted).otherwise(F.transform("embedding", lambda x: F.when(x > 0.3, 30).otherwise(255))).alias("px"))


@query("""
WITH m AS (SELECT label::VARCHAR AS img, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS y, embedding AS e FROM embeddings),
i AS (SELECT img, y, x FROM (SELECT *, unnest(range(0, 64)) AS x FROM m) WHERE CASE WHEN y % 9 = 4 THEN x % 2 = 0 ELSE e[x + 1] > 0.3 END),
v AS (SELECT img, x, y, count(*) OVER (PARTITION BY img, x, g) AS tall FROM (SELECT *, y - row_number() OVER (PARTITION BY img, x ORDER BY y) AS g FROM i)),
h AS (SELECT img, x, y, count(*) OVER (PARTITION BY img, y, g) AS wide FROM (SELECT *, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS g FROM i)),
r AS (SELECT img, y, count(*) AS n, max(x) - min(x) + 1 AS span, count(*) FILTER (tall <= 3) AS thin, max(tall) AS most FROM v GROUP BY 1, 2),
d AS (SELECT img, y FROM r WHERE span >= 0.45 * 64 AND thin >= 0.8 * n AND most <= 18 AND n / span <= 0.75),
o AS (SELECT v.*, d.y IS NOT NULL AND tall <= 3 AND wide <= 4.5 AS gone FROM v JOIN h USING (img, x, y) LEFT JOIN d USING (img, y)),
b AS (SELECT img, y, min(y) OVER (PARTITION BY img, g) AS top, max(y) OVER (PARTITION BY img, g) AS bottom FROM (SELECT *, y - row_number() OVER (PARTITION BY img ORDER BY y) AS g FROM d WHERE img IN (SELECT img FROM o WHERE gone))),
w AS (SELECT * FROM b WHERE bottom - top <= 7.5), s AS (SELECT DISTINCT w.img, w.top, o.x FROM w JOIN o USING (img, y) WHERE NOT o.gone),
z AS (SELECT DISTINCT o.img, o.y, o.x FROM o LEFT JOIN w USING (img, y) LEFT JOIN s ON s.img = o.img AND s.top = w.top AND s.x BETWEEN o.x - 3 AND o.x + 3 WHERE w.top IS NULL OR s.x IS NOT NULL)
SELECT m.img, m.y, count(z.x)::INTEGER AS ink FROM m LEFT JOIN z USING (img, y) GROUP BY 1, 2
""")
def erased_rulings(spark, d):
    """Images without their answer rulings: the ink that each line is left."""
    return bands.facts(bands.erase_rulings(_greys(spark, d))).where("y >= 0").select("img", "y", "ink")


@query()
def prepared_parts(spark, d):
    """Parts made ready: edge rules, rulings, margins and gaps gone."""
    return bands.facts(bands.prepare_parts(_greys(spark, d))).where("y >= 0").select("img", "y", "width", "ink")


@query()
def split_items(spark, d):
    """Items of tall images, cut at their marks and drawn in to their content."""
    rows = _images(spark, d, 0.1)
    marks = rows.where("y % 20 = 10").select("img", F.col("y").alias("row"), F.floor(F.col("y") / 20).cast("int").alias("number"))
    return bands.split_items(rows, marks, 1.0, False, True)


def _parts(spark, d) -> DataFrame:
    """Grey parts of images: rows of a label and a remainder of ids; a part's width goes by its number. img, part, y, px (bytes)."""
    part = F.col("vec_id") % 3
    place = F.row_number().over(Window.partitionBy("label", part).orderBy("vec_id")) - 1
    px = F.transform(F.slice(grey_levels("embedding"), F.lit(1), (64 - 10 * part).cast("int")), lambda v: F.lpad(F.hex(v), 2, "0"))
    rows = load(spark, d, "embeddings", "vec_id", "label", "embedding")
    return rows.select(F.col("label").cast("string").alias("img"), part.cast("int").alias("part"), place.alias("y"), F.unhex(F.array_join(px, "")).alias("px"))


PARTS = """
WITH p AS (SELECT label::VARCHAR AS img, vec_id % 3 AS part, row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) - 1 AS y, 64 - 10 * (vec_id % 3) AS w,
   array_to_string(list_transform(embedding[1:64 - 10 * (vec_id % 3)], lambda x: printf('%02X', ((floor(x * 255) % 256 + 256) % 256)::INTEGER)), '') AS line FROM embeddings),
s AS (SELECT img, part, max(w) AS w, count(*) AS h FROM p GROUP BY 1, 2),
"""


@query(PARTS + """
l AS (SELECT *, coalesce(sum(h + 3) OVER (PARTITION BY img ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 AS top, max(w) OVER (PARTITION BY img) AS wide FROM s),
c AS (SELECT img, wide + 4 AS width, (sum(h + 3) - 3 + 4)::BIGINT AS height FROM l GROUP BY img, wide), y AS (SELECT img, width, unnest(range(0, height)) AS y FROM c),
q AS (SELECT p.img, (p.y + top)::BIGINT AS y, (wide - p.w) // 2 + 2 AS x, p.w, p.line FROM p JOIN l USING (img, part))
SELECT img, y::INTEGER AS y, CASE WHEN line IS NULL THEN repeat('FF', width) ELSE repeat('FF', x) || line || repeat('FF', width - x - w) END AS line FROM y LEFT JOIN q USING (img, y)
""")
def fused_images(spark, d):
    """Parts put below each other, centred, with gaps and a margin: every line of the pictures."""
    return canvas.fused(_parts(spark, d), 3, 2, "center").select("img", "y", F.hex("px").alias("line"))


@query(PARTS + """
l AS (SELECT *, coalesce(sum(w + 3) OVER (PARTITION BY img ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 AS x, max(h) OVER (PARTITION BY img) AS tall FROM s),
c AS (SELECT img, (max(tall) + 4)::BIGINT AS height FROM l GROUP BY img), y AS (SELECT img, height, unnest(range(0, height)) AS y FROM c),
q AS (SELECT y.img, y.y, l.part, l.w, coalesce(p.line, repeat('FF', l.w)) AS line FROM y JOIN l USING (img) LEFT JOIN p ON p.img = y.img AND p.part = l.part AND p.y = y.y - 2 - (l.tall - l.h))
SELECT img, y::INTEGER AS y, 'FFFF' || string_agg(line, 'FFFFFF' ORDER BY part) || 'FFFF' AS line FROM q GROUP BY 1, 2
""")
def fused_across(spark, d):
    """Parts put side by side at the bottom: every line of the pictures."""
    return canvas.fused(_parts(spark, d), 3, 2, "bottom", across=True).select("img", "y", F.hex("px").alias("line"))


@query()
def built_pictures(spark, d):
    """Pictures made ready, put together with parts scaled to one width, and fitted to 40 columns: the ink of every line."""
    made = canvas.built(_parts(spark, d), raster.Settings(max_gap=9, padding=3), 4, 3, "center", match=True, width=40)
    return bands.facts(made).where("y >= 0").select("img", "y", "width", "ink")
