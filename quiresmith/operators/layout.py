"""Furniture, bands and windows of pages, over tables of blocks and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions.numbers import half_even
from quiresmith.functions.strings import MARK_ALLOCATION, is_code_strip, squash, stitched, stripped
from quiresmith.operators.sequences import trimmed_tail

#: Wordings by which pages are told apart.
ANSWER_TABLE = r"(?i)Question\s+Answer\s+(?:Marks|Mark)"
RULING = r"[.…]{12,}"
AWARDING = r"(?i)Cambridge\s+(?:International|Assessment|University\s+Press)"
PAGE_OF = r"(?i)\bPage\s+\d+\s+of\s+\d+\b"
NAVIGATION = r"(?i)^(?:Questions?\s+\d+\s+starts?\s+on\b|Section\s+[A-D]\b\s*$|Answer\s+(?:one|any|all)\b[^.]{0,40}\.?\s*$)"
END_MATTER = r"(?i)The Periodic Table of Elements|Permission to reproduce items|Copyright Acknowledgements Booklet|BLANK PAGE|Additional Page|DATA BOOKLET"
TAIL_MATTER = (
    r"(?i)Important values,? constants and standards|The Periodic Table of Elements|Permission to reproduce items|Copyright Acknowledgements"
    r"|To avoid the issue of disclosure of answer-related information|The boundaries and names shown, the designations used"
)
LOST_MARK = r"\[\s*(?:Total:\s*)?\d{1,2}\s*\]"
PHRASES = ("UCLES", "Turn over", "BLANK PAGE")
NOTICES = ("permission to reproduce", "copyright acknowledgement", "cambridgeinternational.org")
COLUMNS = ("question", "qu", "answer", "answers", "mark", "marks", "total", "totals", "guidance", "notes", "part", "additional")
BANNER = r"(Mark Scheme|Cambridge (?:International|Assessment|University Press)|Question\s+Answer\s+(?:Marks?|Mark)|Page\s+\d+\s+of\s+\d+|PUBLISHED)"
BANNER_WORDS = ("question", "answer", "answers", "mark", "marks", "total", "totals", "guidance")


def furniture_rule(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Name of the first rule that makes a block page furniture; null if it is content."""
    body = stripped(text)
    return _rule_of(body, F.lower(body), _words(body), x0, y0, x1, y1, width, height)


def _words(body: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(body), "/", " "), r"\s+"), lambda w: w != "")


def _rule_of(body: Column, low: Column, words: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """``furniture_rule`` of a text without space at its ends, the same in lower case, and its words."""
    named = F.forall(words, lambda w: w.isin(*COLUMNS))
    enough = F.when(y1 < 0.12 * height, 1).otherwise(2)
    banded = (y1 < 0.16 * height) | (y0 > 0.84 * height)
    centred = F.abs((x0 + x1) / 2 - width / 2) < 0.15 * width
    short_caps = (F.length(body) <= 5) & (F.upper(body) == body) & (low != body)
    rules = (
        ("margin phrase", body.contains("DO NOT WRITE")),
        ("edge bar", ((x1 < 0.06 * width) | (x0 > 0.94 * width)) & (x1 - x0 < 25) & (y1 - y0 > 100)),
        ("code strip", is_code_strip(body)),
        ("starred digits", body.rlike(r"^\*[\s\d]*\*$")),
        ("phrase", F.lit(False) if not PHRASES else _any(body, PHRASES)),
        ("navigation", body.rlike(NAVIGATION)),
        ("running line", banded & (body.rlike(AWARDING) | body.rlike(PAGE_OF) | body.contains("©"))),
        ("banner", body.contains("Mark Scheme")),
        ("published", (y1 < 0.16 * height) & body.contains("PUBLISHED")),
        ("column heading", (F.size(words) >= enough) & named),
        ("notice", _any(low, NOTICES)),
        ("foot", y0 > 0.935 * height),
        ("page number", (y1 < 0.075 * height) & centred & (body.rlike("^[0-9]+$") | short_caps)),
    )
    out = F.when((body == "") | body.isNull(), F.lit(None).cast("string"))
    for name, holds in rules:
        out = out.when(holds, name)
    return out


def _any(body: Column, phrases: tuple[str, ...]) -> Column:
    found = body.contains(phrases[0])
    for p in phrases[1:]:
        found |= body.contains(p)
    return found


def furniture(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks(doc, page, x0, y0, x1, y1, text) that are furniture, with their ``rule`` and their page's size."""
    sized = blocks.join(pages.select("doc", "page", "width", "height"), ["doc", "page"])
    rule = furniture_rule(*(F.col(c) for c in ("text", "x0", "y0", "x1", "y1", "width", "height")))
    return sized.withColumn("rule", rule).where("rule is not null")


def header_footer_bands(blocks: DataFrame, pages: DataFrame, band: float = 0.16) -> DataFrame:
    """doc, head, foot that furniture agrees on over pages."""
    ruled, low, high = _ruled(blocks, pages), F.col("y1") < band * F.col("height"), F.col("y0") > (1 - band) * F.col("height")
    held = F.col("rule").isNotNull()
    edges = ruled.groupBy("doc", "page").agg(F.bool_or("sheet").alias("sheet"), F.max(F.when(held & low, F.col("y1"))).alias("head"), F.min(F.when(held & high, F.col("y0"))).alias("foot"))
    # A document has few pages: its edges are two arrays, in which what two pages agree on stands twice.
    every = edges.where("sheet").groupBy("doc").agg(*(F.array_sort(F.collect_list(half_even(F.col(c)))).alias(c) for c in ("head", "foot")))

    def twice(c: str) -> Column:
        return F.filter(c, lambda x, k: x == F.get(F.col(c), k + 1))

    return every.select("doc", F.coalesce(F.array_max(twice("head")), F.lit(0.0)).alias("head"), F.coalesce(F.array_min(twice("foot")), F.lit(0.0)).alias("foot"))


def _ruled(blocks: DataFrame, pages: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of pages (``sheet``) and of the blocks on them, with their page's size and the ``rule`` that makes a block furniture, and rows of ``more`` (doc, ...).

    They meet by document in one shuffle; a page has one row.
    """
    sheets = pages.select("doc", "page", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), F.lit(True).alias("sheet"))
    box = (F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))
    met = sheets.unionByName(blocks.where("doc is not null and page is not null").select("doc", "page", *box, "text", F.lit(False).alias("sheet")), allowMissingColumns=True)
    for rows in more:
        met = met.unionByName(rows, allowMissingColumns=True)
    page = Window.partitionBy("doc", "page")
    sized = met.repartition("doc").withColumns({"width": F.max("width").over(page), "height": F.max("height").over(page), "_paged": F.max("sheet").over(page)})
    # What many rules look at is made once, step by step.
    read = sized.withColumn("_body", stripped(F.col("text"))).withColumn("_low", F.lower("_body"))
    rule = _rule_of(F.col("_body"), F.col("_low"), _words(F.col("_body")), *(F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height")))
    return read.withColumn("rule", F.when(~F.col("sheet") & F.col("_paged"), rule)).drop("_low")


def redactions(blocks: DataFrame, pages: DataFrame, bands: DataFrame, band: float = 0.16, clear: float = 4.0, slack: float = 2.0) -> DataFrame:
    """doc, page, x0, y0, x1, y1 that furniture takes off its pages.

    Heads reach over the full width and down towards the first content that
    is not all within them, ``clear`` points short of it and within the band,
    but cover their own foot; feet likewise upwards. A wide low heading in mid-page
    grows by ``slack``. Where pages agree on a deeper head or a higher foot,
    that is taken too, up to the content. Tail matter goes to the foot of its
    page.
    """
    deeper = bands.select("doc", F.col("head").cast("double").alias("_band_head"), F.col("foot").cast("double").alias("_band_foot"))
    sized = _ruled(blocks, pages, deeper)
    page, document = Window.partitionBy("doc", "page"), Window.partitionBy("doc")
    plain = F.col("_paged") & F.col("rule").isNull() & (F.col("_body") != "")
    at_head, at_foot = F.col("rule").isNotNull() & (F.col("y1") < band * F.col("height")), F.col("rule").isNotNull() & (F.col("y0") > (1 - band) * F.col("height"))
    marked = sized.withColumns(
        {
            "head": F.coalesce(F.max("_band_head").over(document), F.lit(0.0)),
            "foot": F.coalesce(F.max("_band_foot").over(document), F.lit(0.0)),
            "_head": F.coalesce(F.max(F.when(at_head, F.col("y1"))).over(page), F.lit(0.0)),
            "_foot": F.coalesce(F.min(F.when(at_foot, F.col("y0"))).over(page), F.col("height")),
            "_tail": F.min(F.when(squash(F.col("text")).rlike(TAIL_MATTER), F.col("y0"))).over(page),
        }
    )
    marked = marked.withColumns(
        {
            "_first": F.coalesce(F.min(F.when(plain & (F.col("y1") > F.col("_head")), F.col("y0"))).over(page), F.col("height")),
            "_last": F.coalesce(F.max(F.when(plain & (F.col("y0") < F.col("_foot")), F.col("y1"))).over(page), F.lit(0.0)),
        }
    )
    low, high = band * F.col("height"), (1 - band) * F.col("height")
    down = F.least(F.greatest(F.col("y1"), F.least(F.col("_first") - clear, low)), F.greatest("_first", "y1"))
    up = F.greatest(F.least(F.col("y0"), F.greatest(F.col("_last") + clear, high)), F.least("_last", "y0"))
    across = (F.col("y1") - F.col("y0") < 40) & (F.col("x1") - F.col("x0") > 0.5 * F.col("width"))
    full = at_head | at_foot | across
    width, height, none = F.col("width"), F.col("height"), F.lit(0.0)

    def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    own = area(
        F.when(full, none).otherwise(F.col("x0")),
        F.when(at_head, none).when(at_foot, up).when(across, F.col("y0") - slack).otherwise(F.col("y0")),
        F.when(full, width).otherwise(F.col("x1")),
        F.when(at_head, down).when(at_foot, height).when(across, F.col("y1") + slack).otherwise(F.col("y1")),
    )
    sheet = F.col("sheet")
    heads = area(none, none, width, F.least(F.col("head") + slack, F.col("_first")))
    feet = area(none, F.greatest(F.col("foot") - slack, F.col("_last")), width, height)
    tails = area(none, F.col("_tail") - slack, width, height)
    areas = F.array(
        F.when(F.col("rule").isNotNull(), own),
        F.when(sheet & (F.col("head") > F.col("_head")), heads),
        F.when(sheet & (F.col("foot") > 0) & (F.col("foot") < F.col("_foot")), feet),
        F.when(sheet & F.col("_tail").isNotNull(), tails),
    )
    return marked.select("doc", "page", F.explode(F.filter(areas, lambda a: a.isNotNull())).alias("a")).select("doc", "page", "a.*")


def swept(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    """Blocks that no area of their page touches."""
    b, a = blocks.alias("b"), areas.select("doc", "page", *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1"))).alias("a")
    touch = (F.col("b.doc") == F.col("a.doc")) & (F.col("b.page") == F.col("a.page")) & (F.col("x0") < F.col("_x1")) & (F.col("x1") > F.col("_x0")) & (F.col("y0") < F.col("_y1")) & (F.col("y1") > F.col("_y0"))
    return b.join(a, touch, "left_anti")


def body_spans(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans strictly inside the middle 96 % of their page's height."""
    sized = spans.join(pages.select("doc", "page", "height"), ["doc", "page"])
    return sized.where((F.col("y") > 0.02 * F.col("height")) & (F.col("y") < 0.98 * F.col("height"))).drop("height")


def mended_lines(pieces: DataFrame, step: float = 3.0, slack: float = 0.5) -> DataFrame:
    """doc, page, line, text of pieces(doc, page, x0, x1, y, text): words broken over boxes that overlap are stitched.

    Pieces of a line go from left to right; one that overlaps the box before
    by more than ``slack`` is joined over the longest common end and start.
    """
    line = half_even(F.col("y") / step).cast("long")
    grouped = pieces.groupBy("doc", "page", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("_p"))
    empty = F.struct(F.lit(None).cast("double").alias("edge"), F.array().cast("array<string>").alias("words"))

    def add(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc["words"], F.lit(-1))
        joined = F.when(acc["edge"] - p["x0"] > slack, stitched(last, p["text"]))
        words = F.when(joined.isNotNull(), F.concat(F.slice(acc["words"], 1, F.size(acc["words"]) - 1), F.array(joined))).otherwise(F.concat(acc["words"], F.array(p["text"])))
        return F.struct(F.greatest(acc["edge"], p["x1"]).alias("edge"), words.alias("words"))

    text = F.aggregate("_p", empty, add, lambda acc: squash(F.array_join(acc["words"], " ")))
    return grouped.select("doc", "page", "line", text.alias("text"))


def page_texts(lines: DataFrame) -> DataFrame:
    """doc, page, text: a page's lines in order."""
    joined = lines.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_l"))
    return joined.select("doc", "page", F.array_join(F.col("_l.text"), " ").alias("text"))


def document_facts(texts: DataFrame, name: Column | None = None) -> DataFrame:
    """doc, first_question, answer_page, last_page, kind of page texts(doc, page, text).

    The kind is in the document's name, or else an answer table makes it an
    answer side.
    """
    facts = texts.groupBy("doc").agg(
        F.coalesce(F.min(F.when(F.col("text").rlike(RULING), F.col("page"))), F.lit(0)).alias("first_question"),
        F.min(F.when(F.col("text").rlike(ANSWER_TABLE), F.col("page"))).alias("answer_page"),
    )
    tails = trimmed_tail(texts.withColumn("_end", F.col("text").rlike(END_MATTER)).withColumn("_mark", F.col("text").rlike(MARK_ALLOCATION)), "_end", "_mark")
    said = F.lower(F.regexp_extract(name if name is not None else F.col("doc"), r"(?i)_(qp|ms)_", 1))
    kind = F.when(said != "", said).when(F.col("answer_page").isNotNull(), "ms").otherwise("qp")
    return facts.join(tails, "doc").withColumn("kind", kind)


def after_preamble(spans: DataFrame, facts: DataFrame) -> DataFrame:
    """Spans from the answer page on; all of them where there is none."""
    joined = spans.join(facts.select("doc", "answer_page"), "doc")
    return joined.where(F.col("page") >= F.coalesce("answer_page", F.lit(0))).drop("answer_page")


def page_windows(blocks: DataFrame, pages: DataFrame, margins: dict[str, float], grow: float = 1.0) -> DataFrame:
    """doc, page, left, top, right, foot: the page less its margins, grown so that it cuts no block."""
    def edge(c: str) -> Column:
        return F.lit(float(margins.get(c, 0.0)))

    frame = pages.select("doc", "page", "width", "height", edge("left").alias("_l"), edge("top").alias("_t"), (F.col("width") - edge("right")).alias("_r"), (F.col("height") - edge("bottom")).alias("_f"))
    inside = (F.col("x1") > F.col("_l")) & (F.col("x0") < F.col("_r")) & (F.col("y1") > F.col("_t")) & (F.col("y0") < F.col("_f"))
    reach = frame.join(blocks.select("doc", "page", "x0", "y0", "x1", "y1"), ["doc", "page"], "left")

    def grown(base: str, block: str, low: bool) -> Column:
        cut = inside & ((F.col(block) < F.col(base)) if low else (F.col(block) > F.col(base)))
        value = F.when(cut, F.col(block) - grow if low else F.col(block) + grow)
        return F.least(F.min(base), F.min(value)) if low else F.greatest(F.max(base), F.max(value))

    found = reach.groupBy("doc", "page").agg(
        F.greatest(F.lit(0.0), grown("_l", "x0", True)).alias("left"),
        F.greatest(F.lit(0.0), grown("_t", "y0", True)).alias("top"),
        F.least(F.max("width"), grown("_r", "x1", False)).alias("right"),
        F.least(F.max("height"), grown("_f", "y1", False)).alias("foot"),
    )
    return found


def lost_marks(blocks: DataFrame, windows: DataFrame) -> DataFrame:
    """doc, page, text, why of mark allocations outside their page's window or cut by it; a total needs its colon."""
    marked = blocks.where(F.col("text").rlike(LOST_MARK)).join(windows, ["doc", "page"])
    outside = (F.col("y1") <= F.col("top")) | (F.col("y0") >= F.col("foot"))
    cut = (F.col("y0") < F.col("top")) | (F.col("y1") > F.col("foot"))
    why = F.when(outside, "outside the window").when(cut, "cut by the window")
    return marked.select("doc", "page", F.left(squash(F.col("text")), F.lit(40)).alias("text"), why.alias("why")).where("why is not null")


def shredded(blocks: DataFrame) -> DataFrame:
    """doc, shredded: whether its text comes in pieces of a few letters."""
    body = squash(F.col("text"))
    worded = blocks.where(body.rlike(r"\p{L}")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(body) <= 6).alias("short"))
    return worded.select("doc", ((F.col("n") >= 20) & (F.col("short") > 0.5 * F.col("n"))).alias("shredded"))


def left_furniture(texts: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page, text of the first body page that still bears a banner, or a column word in its top fifth."""
    banner = texts.where(F.col("text").rlike(BANNER)).select("doc", "page", F.regexp_extract("text", BANNER, 1).alias("text"))
    word = F.btrim(F.lower(squash(F.col("text"))), F.lit(":"))
    near = blocks.join(pages.select("doc", "page", "height"), ["doc", "page"]).where(F.col("y0") < 0.20 * F.col("height"))
    words = near.where(word.isin(*BANNER_WORDS)).select("doc", "page", word.alias("text"), "y0")
    lone = words.join(banner.select("doc", "page"), ["doc", "page"], "left_anti").groupBy("doc", "page").agg(F.min_by("text", "y0").alias("text"))
    found = banner.unionByName(lone)
    return found.groupBy("doc").agg(F.min("page").alias("page"), F.min_by("text", "page").alias("text"))
