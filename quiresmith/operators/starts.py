"""Where a document's items start.

Spans meet by document once: windows tell which open their line, and those
that read as labels or headings go on in reading order. Labels that open
a line are banded into columns; the best column by a scored tuple gives the
items, those whose label ran into its wording are recovered between their
neighbours, and the longest rising chain stands. These steps carry a place
from one number to the next, so they run over a document's marks in an
Arrow kernel; documents are independent and spread over the cluster.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions.numbers import half_even
from quiresmith.functions.strings import HIGHEST_LABEL, LABEL_START, WORDED_HEADING, label_number, matched_number, stripped
from quiresmith.operators.chains import counting_chain, rising_chain
from quiresmith.operators.kernels import by_document
from quiresmith.operators.sequences import opens_line

#: How far numbers past the highest label are looked for, and where a column's band ends on either side.
BEYOND, BAND, EDGE = 11, (12.0, 20.0), (4.0, 40.0)


def _body(text: str = "text") -> Column:
    return stripped(F.col(text))


class Mark(NamedTuple):
    """A span that opens its line with a number or a heading in words.

    It has its ``label`` number, the number that its text leads with
    (``lead``), the number of its heading (``head``) among the spans of an
    answer side, and whether it is ``bare`` of wording; -1 is no number.
    """

    page: int
    y: float
    ord: int
    left: float
    centre: float
    label: int
    lead: int
    head: int
    bare: bool


def openings(spans: DataFrame) -> DataFrame:
    """Marks of documents with their ``side`` (an answer side), in reading order, and a row that is not ``here`` for a page without a mark at its head."""
    side = F.col("kind").eqNullSafe("ms")
    # A document's spans meet in one shuffle; lines, pages and the order are within it.
    opened = opens_line(spans.where("doc is not null").repartition("doc"), opens_answers=side)
    page = Window.partitionBy("doc", "page").orderBy(F.lit(1))
    paged = opened.select("*", side.alias("side"), (F.row_number().over(page) == 1).alias("begins"), F.when(F.col("opens") | F.col("opens_answers"), _body()).alias("body"))
    label = F.when(F.col("opens"), label_number(F.col("body")))
    lead = F.when(F.col("opens"), matched_number(F.col("body"), r"^([1-9][0-9]?)(?=$|[\s(])"))
    head = F.when(F.col("opens_answers"), matched_number(F.col("body"), WORDED_HEADING))
    bare = F.when(F.col("side"), F.col("body").rlike(LABEL_START))
    found = dict(page=F.col("page").cast("int"), y=F.col("y").cast("double"), ord=F.col("ord").cast("long"), left=F.col("left").cast("double"), centre=F.col("centre").cast("double"), label=label, lead=lead, head=head, bare=bare)
    marks = paged.select("doc", "side", "begins", *(found[c].alias(c) for c in Mark._fields))
    here = F.col("y").isNotNull() & F.col("left").isNotNull() & F.col("centre").isNotNull() & F.coalesce("label", "lead", "head").isNotNull()
    marks = marks.withColumn("here", F.coalesce(here, F.lit(False))).where("page is not null and (here or begins)").drop("begins")
    marks = marks.fillna({"y": 0.0, "ord": -1, "left": 0.0, "centre": 0.0, "label": -1, "lead": -1, "head": -1, "bare": False})
    return marks.sortWithinPartitions("doc", "page", "y", "ord", "left", "centre")


def headings(marks: list[Mark]) -> list[tuple]:
    """page, y, number of a document's headings in words, where these count from one without a break."""
    first: dict[int, Mark] = {}
    for m in marks:
        n = m.head
        if n >= 0 and (n not in first or (m.page, m.ord) < (first[n].page, first[n].ord)):
            first[n] = m
    whole = len(first) >= 2 and min(first) == 1 and max(first) == len(first)
    return [(m.page, m.y, n) for n, m in sorted(first.items())] if whole else []


def best_column(labels: list[Mark], tolerance: float) -> tuple[list[Mark], int, float, int] | None:
    """A document's best column of labels whose numbers count up at least once: its labels, the field of its edge, its seed and the pages that the count spans.

    The first label of each number in each bucket counts, along left edges and
    centres, and a column is what lies within ``tolerance`` of one of them.
    Scores compare field by field: at the margin, upright, pages that the
    count spans, from one, its length, numbers held, further left.
    """
    bands = []
    for axis, edge in enumerate(("left", "centre")):
        at = Mark._fields.index(edge)
        once: dict[tuple, int] = {}
        for k, m in enumerate(labels):
            once.setdefault((round(m[at] / max(1.0, tolerance)), m.label), k)
        across = sorted((labels[k][at], k) for k in once.values())
        xs = [x for x, _ in across]
        bands.extend((seed <= xs[0] + tolerance, seed, -axis, at, across, xs) for seed in dict.fromkeys(xs))
    best = None
    # Those at the margin come first: no other is better than one of them.
    for at_margin, seed, axis, at, across, xs in sorted(bands, key=lambda b: not b[0]):
        if best is not None and best[0][0] > at_margin:
            break
        # Edges of the band are compared as differences are.
        near = across[bisect_left(xs, seed - tolerance - 1.0) : bisect_right(xs, seed + tolerance + 1.0)]
        held = [labels[k] for k in sorted(k for x, k in near if abs(x - seed) <= tolerance)]
        chain = counting_chain([m.label for m in held])
        if len(chain) < 2:
            continue
        numbers, places = {m.label for m in held}, [m[at] for m in held]
        pages = len({held[k].page for k in chain})
        score = (at_margin, len(held) <= 2 or max(places) - min(places) <= 1.0, pages, min(numbers) == 1, len(chain), len(numbers), -seed, axis)
        if best is None or score > best[0]:
            best = (score, held, at, seed, pages)
    return best and best[1:]


def filled(marks: list[Mark], column: list[Mark], edge: int, seed: float, tolerance: float) -> list[tuple]:
    """page, y, number of a column's labels, and of those recovered between their neighbours or past the last.

    A number that is missing is taken where a span in line with the column
    starts with it, opens its line, and stands after all smaller numbers and
    before all larger ones. Past the highest, the first miss ends the search.
    """
    low, high = min(m.left for m in column) - tolerance, max(m.left for m in column) + tolerance
    offers: dict[int, list[tuple]] = {}
    for m in marks:
        if m.lead > 0 and (low <= m.left <= high or abs(m[edge] - seed) <= tolerance):
            offers.setdefault(m.lead, []).append((m.page, m.y))
    own: dict[int, list[tuple]] = {}
    for m in column:
        own.setdefault(m.label, []).append((m.page, m.y))
    top = max(own)
    last = max(top, min(top + BEYOND, HIGHEST_LABEL))
    roofs, roof = {}, None
    for n in range(last, 0, -1):
        roofs[n] = roof
        if n in own:
            roof = min(own[n]) if roof is None else min(roof, min(own[n]))
    out, floor = [(*at, n) for n, places in own.items() for at in places], (-1, -1.0)
    for n in range(1, last + 1):
        if n in own:
            floor = max(floor, max(own[n]))
            continue
        hit = next((at for at in offers.get(n, ()) if at > floor and (roofs[n] is None or at < roofs[n])), None)
        if hit is not None:
            out.append((*hit, n))
            floor = hit
        elif n > top:
            break
    return out


def snapped(starts: list[tuple], labels: list[Mark], column: list[Mark], tolerance: float) -> list[tuple]:
    """Starts moved up to the first label of the column with their number, never past the start before."""
    left, centre = (sorted(edges)[len(column) // 2] for edges in ([m.left for m in column], [m.centre for m in column]))
    offers: dict[int, list[tuple]] = {}
    for m in labels:
        if m.bare and (abs(m.left - left) <= 2 * tolerance or abs(m.centre - centre) <= 2 * tolerance):
            offers.setdefault(m.label, []).append((m.page, m.y))
    out, floor = [], (-1, -1.0)
    for page, y, number in starts:
        floor = min((page, y), next((at for at in offers.get(number, ()) if at > floor), (page, y)))
        out.append((*floor, number))
    return out


def starts_of_marks(marks: list[Mark], inked: int, answers: bool, tolerance: float) -> list[tuple]:
    """page, y, number of a document's items: by its headings, or else by its best column; a count on one page of several is none."""
    worded = headings(marks)
    if worded:
        return worded
    labels = [m for m in marks if m.label > 0]
    best = best_column(labels, tolerance)
    if best is None or (best[3] < 2 and inked > 2):
        return []
    column, edge, seed, _ = best
    full = sorted(filled(marks, column, edge, seed, tolerance))
    rising = [full[k] for k in rising_chain([n for *_, n in full])]
    return snapped(rising, labels, column, tolerance) if answers else rising


def find_starts(spans: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """doc, page, y, number of the items of spans(doc, kind, page, ord, left, centre, y, text).

    A question side goes by its column; an answer side (kind ``ms``) by its
    headings, or else by its column moved up to first labels. Spans without a
    place take no part.
    """
    listed = openings(spans.select("doc", "kind", "page", "ord", "left", "centre", "y", "text"))
    kind = spans.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, marks, pages, answers = None, [], set(), False
        docs, found = [], []

        def close() -> None:
            own = starts_of_marks(marks, len(pages), answers, tolerance)
            docs.extend([doc] * len(own))
            found.extend(own)

        def table() -> pa.RecordBatch:
            page, y, number = zip(*found) if found else ((), (), ())
            made = pa.record_batch([pa.array(docs, types[0]), pa.array(page, pa.int32()), pa.array(y, pa.float64()), pa.array(number, pa.int32())], ["doc", "page", "y", "number"])
            docs.clear()
            found.clear()
            return made

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column("doc").type]
            runs, start = pc.run_end_encode(batch.column("doc")), 0
            side, here, *fields = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("side", "here", *Mark._fields))
            rows = list(zip(*fields))
            for now, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if now != doc:
                    if marks:
                        close()
                    doc, marks, pages, answers = now, [], set(), False
                pages.update(fields[0][start:end])
                answers |= any(side[start:end])
                marks.extend(Mark._make(rows[k]) for k in range(start, end) if here[k])
                start = end
            yield table()
        if marks:
            close()
            yield table()

    return listed.mapInArrow(run, f"doc {kind}, page int, y double, number int")


#: What a row of a reading is.
SWEPT, RAW, START, WANTED, BETWEEN = range(5)


def _role(rows: DataFrame, role: int, **values: Column) -> DataFrame:
    """Rows of documents as readings take them; what ``values`` do not have is -1, 0 or null."""
    none = F.lit(0.0)
    fields = dict(page=F.lit(-1), y=none, left=none, line=none, ord=F.lit(-1), label=F.lit(-1), number=F.lit(-1), target=F.lit(None)) | values
    kinds = dict(page="int", y="double", left="double", line="double", ord="long", label="int", number="int", target="array<int>")
    return rows.select("doc", F.lit(role).alias("role"), *(fields[c].cast(t).alias(c) for c, t in kinds.items()))


def _placed(spans: DataFrame, role: int) -> DataFrame:
    """Spans with the number that they lead with and that of their label (-1: none); what has no place takes no part."""
    number = matched_number(_body(), r"^([1-9][0-9]*)(?=$|[\s(.])")
    order = F.coalesce("ord", F.lit(-1)) if "ord" in spans.columns else F.lit(-1)
    held = spans.where("doc is not null and page is not null and y is not null and left is not null")
    return _role(held, role, page=F.col("page"), y=F.col("y"), left=F.col("left"), line=half_even(F.col("y") / 3.0), ord=order, label=F.coalesce(label_number(F.col("text")), F.lit(-1)), number=F.coalesce(number, F.lit(-1)))


def _begun(starts: DataFrame) -> DataFrame:
    held = starts.where("doc is not null and page is not null and y is not null and number is not null")
    return _role(held, START, page=F.col("page"), y=F.col("y"), number=F.col("number"))


def _asked(wanted: DataFrame) -> DataFrame:
    return _role(wanted.where("target is not null"), WANTED, target=F.col("target"))


def _parted(rows: list[tuple]) -> list[list[tuple]]:
    """A document's rows by their role; each is (role, page, y, left, line, ord, label, number, target)."""
    held: list[list[tuple]] = [[] for _ in range(5)]
    for r in rows:
        held[r[0]].append(r)
    return held


def edge_of(spans: list[tuple]) -> tuple[float, float] | None:
    """The band along a document's left edge."""
    edge = min((r[3] for r in spans), default=None)
    return None if edge is None else (edge - EDGE[0], edge + EDGE[1])


def band_of(spans: list[tuple], starts: list[tuple]) -> tuple[float, float] | None:
    """Where a document's labels are looked for: about those that its starts were read from, by their upper median, or else about its left edge."""
    begun: dict[tuple, list[float]] = {}
    for _, page, y, *_, number, _ in starts:
        begun.setdefault((page, number), []).append(y)
    first: dict[tuple, tuple] = {}
    for _, page, y, left, _, ord_, label, _, _ in spans if begun else ():
        key = (page, label)
        if label > 0 and key in begun and any(abs(at - y) < 0.5 for at in begun[key]):
            first[key] = min(first.get(key, (ord_, left)), (ord_, left))
    if first:
        middle = sorted(left for _, left in first.values())[len(first) // 2]
        return middle - BAND[0], middle + BAND[1]
    return edge_of(spans)


def offered(spans: list[tuple]) -> list[tuple]:
    """page, y, number, left of the spans that open their line (of three points) with a number, in reading order."""
    first: dict[tuple, float] = {}
    for _, page, _, left, line, *_ in spans:
        key = (page, line)
        if left < first.get(key, left + 1.0):
            first[key] = left
    return sorted((page, y, number, left) for _, page, y, left, line, _, _, number, _ in spans if number > 0 and left <= first[page, line] + 0.5)


def hunted(offers: list[tuple], band: tuple[float, float] | None, target: list) -> list[tuple]:
    """page, y, number of the first offer in the band of each number in turn, after the one before; misses move nothing."""
    if band is None:
        return []
    places: dict[int, list[tuple]] = {}
    for page, y, number, left in offers:
        if band[0] <= left <= band[1]:
            places.setdefault(number, []).append((page, y))
    floor, out = (-1, -1.0), []
    for number in target:
        at = places.get(number, ())
        k = bisect_right(at, floor)
        if k < len(at):
            floor = at[k]
            out.append((*floor, number))
    return out


def start_bands(spans: DataFrame, starts: DataFrame) -> DataFrame:
    """doc, low, high: left edges where labels are looked for, about those of the starts, or else about the document's edge."""

    def run(rows: list[tuple]) -> list[tuple]:
        own = _parted(rows)
        band = band_of(own[SWEPT], own[START])
        return [band] if band else []

    return by_document(_placed(spans, SWEPT).unionByName(_begun(starts)), run, low="double", high="double")


def hunt(spans: DataFrame, wanted: DataFrame, bands: DataFrame) -> DataFrame:
    """doc, page, y, number: the first place in the band of each number of wanted(doc, target) in turn, after the one before; misses move nothing."""
    asked = _asked(wanted).unionByName(_role(bands.where("low is not null and high is not null"), BETWEEN, left=F.col("low"), y=F.col("high")))

    def run(rows: list[tuple]) -> list[tuple]:
        own = _parted(rows)
        bands, targets = [(r[3], r[2]) for r in own[BETWEEN]], [r[-1] for r in own[WANTED]]
        offers = offered(own[SWEPT]) if bands and targets else []
        return [start for band in bands for target in targets for start in hunted(offers, band, target)]

    return by_document(_placed(spans, SWEPT).unionByName(asked), run, page="int", y="double", number="int")


def read_thrice(swept: DataFrame, raw: DataFrame, wanted: DataFrame, starts: DataFrame) -> DataFrame:
    """doc, reading, found of wanted(doc, target): the first of three ways that finds all numbers, or null, and what it or the last one found.

    The ways are the band of the starts, the left edge, and that edge among
    ``raw`` spans. A number that is asked for once is hit once at most, so as
    many hits as numbers are all of them.
    """

    def run(rows: list[tuple]) -> list[tuple]:
        swept, raw, starts, wanted, _ = _parted(rows)
        if not wanted:
            return []
        offers, edge, out = offered(swept), edge_of(swept), []
        ways = (lambda: (offers, band_of(swept, starts)), lambda: (offers, edge), lambda: (offered(raw), edge))
        for target in (w[-1] for w in wanted):
            for number, way in enumerate(ways, 1):
                found = hunted(*way(), target)
                if len(found) == len(target):
                    break
            whole = number if len(found) == len(target) else None
            out.append((whole, [dict(zip(("page", "y", "number"), x)) for x in found]))
        return out

    rows = _placed(swept, SWEPT).unionByName(_placed(raw, RAW)).unionByName(_begun(starts)).unionByName(_asked(wanted))
    return by_document(rows, run, reading="int", found="array<struct<page:int,y:double,number:int>>")


def hunt_starts(spans: DataFrame) -> DataFrame:
    """doc, page, y, number for spans with a ``target`` array of wanted numbers per document; the band comes from its own reading."""
    wanted = spans.groupBy("doc").agg(F.first("target").alias("target"))
    return hunt(spans, wanted, start_bands(spans, find_starts(spans)))
