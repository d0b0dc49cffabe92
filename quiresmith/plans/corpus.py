"""Corpus plans: audit, classification, repair targets, verdicts, requeue and hand-over.

Each takes tables and gives a table; nothing is written. An audit row has a
name, its kind, the numbers read (questions) and its faults.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions.names import document_fields, document_name, family, is_document, pair_key, partner
from quiresmith.functions.strings import PART, label_number, opens_as_label
from quiresmith.operators import starts as item_starts
from quiresmith.operators.kernels import by_document
from quiresmith.operators.relations import HARMLESS, first_by, fixable, small_side, texts, with_fault, with_partner
from quiresmith.operators.sequences import is_complete, until_next
from quiresmith.session import materialize

#: Faults that pictures cannot answer for, and answer sides that are short as published.
ABOUT_PICTURES = ("clipped", "furniture")
SHORT_ANSWER_SIDES = {"9701_s24_ms_22": 4, "9709_s24_ms_33": 10}
#: Fixed value: faults of pictures, which leave a reading able to teach its partner.
IN_PICTURES = ("clipped", "stale")
#: Numbers of items that were counted by hand.
BY_HAND = {"9700_s25_ms_51": 2, "9709_w23_ms_43": 7, "9702_w16_ms_51": 2, "9702_w16_ms_53": 2, "9709_s18_ms_33": 10}


def _numbers(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<int>"))


def _lookup(table: dict[str, int], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.try_element_at(pairs, key)


def numbers_by_paper(artifacts: DataFrame) -> DataFrame:
    """paper, numbers (sorted) of artifacts(paper, number)."""
    return artifacts.where("number is not null").groupBy("paper").agg(F.array_sort(F.collect_list("number")).alias("numbers"))


def starts_of(questions: DataFrame) -> DataFrame:
    """Starts(doc, page, y, number) with where the next one opens (stop_page, stop_y); null at the last."""
    ordered = until_next(questions, ["doc"], ["page", "y"], "page", "stop_page")
    return until_next(ordered, ["doc"], ["page", "y"], "y", "stop_y")


def column_bands(spans: DataFrame, starts: DataFrame, slack: float = 6.0) -> DataFrame:
    """doc, low, high: left edges of the labels that starts were read from, with slack."""
    on = ["doc", "page"]
    near = spans.withColumn("_n", label_number(F.col("text"))).join(starts.select("doc", "page", F.col("y").alias("_y"), "number"), on)
    near = near.where((F.abs(F.col("y") - F.col("_y")) < 0.5) & (F.col("_n") == F.col("number")))
    used = first_by(near, ["doc", "page", "number"], "ord")
    return used.groupBy("doc").agg((F.min("left") - slack).alias("low"), (F.max("left") + slack).alias("high"))


def interval_faults(spans: DataFrame, starts: DataFrame, slack: float = 2.0) -> DataFrame:
    """doc, number, first_part, foreign: the first part label inside each item, and whether the next item's label stands in it."""
    has = "doc is not null and page is not null and y is not null"
    nothing, bracket, body = F.lit(-1), F.contains("text", F.lit("(")), F.trim("text")
    asked = dict(page=F.col("page").cast("int"), y=F.col("y").cast("double"), left=F.coalesce(F.col("left").cast("double"), F.lit(float("nan"))), ord=F.coalesce(F.col("ord").cast("long"), nothing), label=F.coalesce(label_number(F.col("text")), nothing), opens=F.coalesce(opens_as_label(F.col("text")), F.lit(False)), part=F.when(bracket, F.nullif(F.regexp_extract(body, PART, 2), F.lit(""))), of=F.coalesce(F.when(bracket, F.regexp_extract(body, PART, 1).try_cast("int")), nothing))
    read = spans.where(has).select("doc", F.lit(False).alias("start"), *(c.alias(name) for name, c in asked.items()))
    begun = starts.where(has).select("doc", F.lit(True).alias("start"), F.col("page").cast("int").alias("page"), F.col("y").cast("double").alias("y"), F.lit(0.0).alias("left"), nothing.cast("long").alias("ord"), F.col("number").cast("int").alias("label"), F.lit(False).alias("opens"), F.lit(None).cast("string").alias("part"), nothing.alias("of"))

    def run(rows: list[tuple]) -> list[tuple]:
        return parts_between([r for r in rows if r[0]], [r for r in rows if not r[0]], slack)

    return by_document(read.unionByName(begun), run, number="int", first_part="string", foreign="boolean")


def parts_between(starts: list[tuple], spans: list[tuple], slack: float, beside: float = 6.0) -> list[tuple]:
    """number, first_part, foreign of a document's items that hold a span; rows are (start, page, y, left, ord, label, opens, part, of)."""
    places: dict[tuple, list[float]] = {}
    for _, page, y, _, _, number, *_ in starts:
        places.setdefault((page, number), []).append(y)
    used: dict[tuple, tuple] = {}
    for _, page, y, left, at, label, *_ in spans:
        if label > 0 and left == left and any(abs(y - own) < 0.5 for own in places.get((page, label), ())):
            used[page, label] = min(used.get((page, label), (at, left)), (at, left))
    lefts = [left for _, left in used.values()]
    low, high = (min(lefts) - beside, max(lefts) + beside) if lefts else (0.0, 0.0)
    ordered = sorted((s[1], s[2] - slack, k) for k, s in enumerate(starts))
    opens, numbers = [x[:2] for x in ordered], [starts[x[2]][5] for x in ordered]
    first: dict[int | None, tuple | None] = {}
    foreign: set[int] = set()
    for _, page, y, left, _, label, label_like, part, of in spans:
        k = bisect_right(opens, (page, y)) - 1
        if k < 0:
            continue
        number = numbers[k]
        best = first.setdefault(number, None)
        if part is not None and left <= high + 40.0 and of in (-1, number) and (best is None or (page, y, part) < best):
            first[number] = (page, y, part)
        if label_like and low <= left <= high and number is not None and label == number + 1:
            foreign.add(number)
    return [(number, best and best[2], number in foreign) for number, best in first.items()]


def audit(documents: DataFrame, starts: DataFrame, intervals: DataFrame, flags: DataFrame) -> DataFrame:
    """name, kind, questions, faults of documents(doc, kind).

    ``flags`` may have shredded, rotations, furniture and error per document;
    absent rows count as none. Without questions, later faults do not show.
    """
    read = starts.where("number is not null").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "y", "number"))), lambda s: s["number"]).alias("questions"))
    spoilt = intervals.groupBy("doc").agg(F.bool_or(~F.col("first_part").isin("a", "i")).alias("missing_part"), F.bool_or("foreign").alias("foreign"))
    rows = documents.join(read, "doc", "left").join(spoilt, "doc", "left").join(flags, "doc", "left")
    some = F.size(_numbers("questions")) > 0
    straight = F.col("questions") == F.sequence(F.lit(1), F.greatest(F.size("questions"), F.lit(1)))
    faults = F.array().cast("array<string>")
    for fault, when in (
        ("shredded", F.col("shredded")),
        ("mixed-rotation", F.col("rotations") > 1),
        ("no-questions", ~some & F.col("error").isNull()),
        ("gap", some & ~straight),
        ("missing-part", some & F.col("missing_part")),
        ("foreign-label", some & F.col("foreign")),
        ("furniture", some & F.col("furniture").isNotNull()),
        ("error", F.col("error").isNotNull()),
    ):
        faults = with_fault(faults, fault, when)
    return rows.select(F.col("doc").alias("name"), "kind", _numbers("questions").alias("questions"), faults.alias("faults"))


def audit_outputs(rows: DataFrame, artifacts: DataFrame, edges: DataFrame, written: DataFrame) -> DataFrame:
    """Audit rows with the faults that outputs show: no-output, clipped, stale and pair-mismatch.

    ``edges`` has the worst edge of each artifact (paper, worst); ``written``
    the papers that left anything.
    """
    held = artifacts.groupBy(F.col("paper").alias("name")).agg(F.count(F.lit(1)).alias("_held"))
    clipped = edges.where("worst > 0.5").select(F.col("paper").alias("name")).distinct().withColumn("_clipped", F.lit(True))
    seen = written.select(F.col("paper").alias("name")).distinct().withColumn("_written", F.lit(True))
    out = rows.join(held, "name", "left").join(clipped, "name", "left").join(seen, "name", "left")
    mates = rows.select(F.col("name").alias("_mate"), F.size(_numbers("questions")).alias("_theirs"))
    out = out.withColumn("_mate", partner(F.col("name"))).join(mates, "_mate", "left")
    own = F.size(_numbers("questions"))
    faults = F.col("faults")
    for fault, when in (
        ("no-output", F.col("_written").isNull()),
        ("clipped", F.col("_clipped")),
        ("stale", (F.col("_held") > 0) & (own > 0) & (F.col("_held") != own)),
        ("pair-mismatch", (own > 0) & (F.col("_theirs") > 0) & (own != F.col("_theirs"))),
    ):
        faults = with_fault(faults, fault, when)
    return out.select("name", "kind", "questions", faults.alias("faults"))


def _of_mate(row: Column, field: str) -> Column:
    """A field of the row in the document's group whose name is ``_mate``, null where there is none. A group has few rows: its names."""
    return F.get(F.filter(F.collect_list(row).over(Window.partitionBy("_key")), lambda x: x["name"] == F.col("_mate")), F.lit(0))[field]


def classify(rows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """name, verdict (clean or review), reasons and pictures of audit rows that have pictures."""
    name = F.col("name")
    # One shuffle brings both sides of a document together: rows, pictures, partners and their verdicts are all by its key.
    read = rows.select(pair_key(name).alias("_key"), "name", F.struct("ord", "faults").alias("row"))
    drawn = artifacts.select(pair_key(F.col("paper")).alias("_key"), F.col("paper").alias("name"), "number")
    sides = read.unionByName(drawn, allowMissingColumns=True).where("name is not null").repartition("_key").groupBy("_key", "name").agg(F.min("row").alias("row"), F.array_sort(F.collect_list("number")).alias("own"), F.count("number").alias("pictures"))
    sides = sides.withColumns({"_mate": partner(name), "faults": F.col("row.faults")})
    have = sides.withColumn("theirs", _of_mate(F.struct("name", "own"), "own")).withColumn("theirs", F.when(F.size("theirs") > 0, F.col("theirs")))
    own, theirs = F.col("own"), F.col("theirs")
    short = _lookup(SHORT_ANSWER_SIDES, F.when(F.col("name").contains("_ms_"), F.col("name")).otherwise(F.col("_mate")))
    longer = F.when(F.size(own) > F.size(theirs), own).otherwise(theirs)
    shorter = F.when(F.size(own) > F.size(theirs), theirs).otherwise(own)
    allowed = (shorter == F.sequence(F.lit(1), short)) & (F.slice(longer, 1, short) == shorter)
    corroborated = (F.size(own) > 0) & is_complete(own) & ((own == theirs) | allowed)
    left = F.array_except("faults", texts(HARMLESS))
    sound = ~F.arrays_overlap("faults", texts(ABOUT_PICTURES)) & (F.coalesce(corroborated, F.lit(False)) | (F.size(left) == 0))
    # Only what has a row and pictures is judged, and can be a partner that is sound.
    known = F.col("row").isNotNull() & (F.col("pictures") > 0)
    judged = have.withColumns({"sound": known & F.coalesce(sound, F.lit(False)), "_left": left, "known": known})
    judged = judged.withColumn("_mate_sound", _of_mate(F.struct("name", "sound"), "sound")).where("known")
    lone = F.col("_mate").isNotNull() & ~F.coalesce("_mate_sound", F.lit(False))
    reasons = (
        F.when(~F.col("sound") & (F.size("_left") > 0), F.array_sort("_left"))
        .when(~F.col("sound"), texts(["pictures do not pair"]))
        .when(lone, texts(["no usable partner"]))
        .otherwise(F.array().cast("array<string>"))
    )
    return judged.select("name", F.when(F.col("sound") & ~lone, "clean").otherwise("review").alias("verdict"), reasons.alias("reasons"), "pictures")


def sound_reading(faults: Column, questions: Column, aside: Sequence[str] = ()) -> Column:
    """Whether a reading stands by itself: no fault but harmless ones, its pair's and those set ``aside``, and numbers 1 to n."""
    left = F.array_except(faults, texts((*HARMLESS, "pair-mismatch", *aside)))
    return F.coalesce((F.size(left) == 0) & (F.size(questions) > 0) & (questions == F.sequence(F.lit(1), F.greatest(F.size(questions), F.lit(1)))), F.lit(False))


def repair_targets(rows: DataFrame, families: DataFrame, done: DataFrame | None = None, inventory: DataFrame | None = None) -> DataFrame:
    """name, target, source of the audit rows that are worth reading again.

    The target is the partner's list if that is sound, else the size of a
    certain family, else the numbers up to the highest read where one is missing.
    """
    # One shuffle brings a document's sides together.
    keyed = rows.where("name is not null").select("name", "ord", "questions", "faults", pair_key(F.col("name")).alias("_key")).repartition("_key")
    first = first_by(keyed, ["_key", "name"], "ord").withColumn("_mate", partner(F.col("name")))
    mate = F.struct("name", F.struct("questions", "faults").alias("read"))
    asked = first.withColumn("_read", _of_mate(mate, "read")).where(fixable(F.col("faults")) & document_name(F.col("name")).isNotNull())
    if done is not None:
        asked = asked.join(done.select("name"), "name", "left_anti")
    if inventory is not None:
        asked = asked.join(inventory.select("name"), "name", "left_semi")
    shapes = small_side(families.where("certain").select(F.col("family").alias("_family"), F.col("questions").alias("_size")))
    joined = asked.select("*", F.col("_read.questions").alias("_theirs"), F.col("_read.faults").alias("_their_faults"), family(F.col("name")).alias("_family")).join(shapes, "_family", "left")
    taught = sound_reading(F.col("_their_faults"), F.col("_theirs"))
    gap = F.array_contains("faults", "gap") & (F.size(_numbers("questions")) > 0)

    def up_to(n: Column) -> Column:
        return F.sequence(F.lit(1), n.cast("int"))

    target = F.when(taught, F.col("_theirs")).when(F.col("_size").isNotNull(), up_to(F.col("_size"))).when(gap, up_to(F.array_max("questions")))
    source = F.when(taught, "partner").when(F.col("_size").isNotNull(), "family").when(gap, "gap")
    return joined.select("name", target.alias("target"), source.alias("source")).where("target is not null")


def repair_outcome(tried: DataFrame) -> DataFrame:
    """Rows(before, after, target, source) with what came of reading again.

    Nothing read and the same list are no better; fewer items are taken only
    from a family's shape that they match exactly; what is taken has repaired
    the paper if it meets the target, and improved it if not.
    """
    before, after = F.size(_numbers("before")), F.size(_numbers("after"))
    met = F.col("after") == F.col("target")
    outcome = (
        F.when(F.col("error").isNotNull(), "error")
        .when((after == 0) | (_numbers("after") == _numbers("before")), "no better")
        .when((after < before) & ~((F.col("source") == "family") & F.coalesce(met, F.lit(False))), "worse")
        .when(met, "repaired")
        .otherwise("improved")
    )
    return tried.withColumn("outcome", outcome)


def match_ups(rows: DataFrame, handed: DataFrame | None = None) -> DataFrame:
    """name, target, action of rows in a pair that disagrees: match to a sound partner, or stuck if neither is sound."""
    every = first_by(rows, ["name"], "ord")
    own = sound_reading(F.col("faults"), F.col("questions"), IN_PICTURES)
    both = with_partner(every.withColumn("sound", own))
    pairs = both.where(F.array_contains("faults", "pair-mismatch") & ~F.col("sound") & F.col("mate_name").isNotNull())
    if handed is not None:
        pairs = pairs.join(handed.select("name"), "name", "left_anti")
    return pairs.select("name", F.when(F.col("mate_sound"), F.col("mate_questions")).alias("target"), F.when(F.col("mate_sound"), "match").otherwise("stuck").alias("action"))


def double_check(papers: DataFrame) -> DataFrame:
    """name, passed, reasons of papers(name, numbers, mate_numbers, cut, empty) after a repair."""
    reasons = F.filter(
        F.array(
            F.when(~is_complete(_numbers("numbers")) | (F.size(_numbers("numbers")) == 0), "not one to n"),
            F.when(F.col("mate_numbers").isNotNull() & (F.size("mate_numbers") != F.size(_numbers("numbers"))), "partner has another count"),
            F.when(F.col("cut") > 0, "cut edges"),
            F.when(F.col("empty") > 0, "empty pictures"),
        ),
        lambda r: r.isNotNull(),
    )
    return papers.select("name", (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def revert_plan(repaired: DataFrame, rows: DataFrame) -> DataFrame:
    """name, action (keep or undo) of repaired(name, before, after): kept if the partner is clean and nothing was there before or counts agree."""
    mates = first_by(rows, ["name"], "ord").select(F.col("name").alias("_mate"), (F.size(F.array_except("faults", texts(HARMLESS))) == 0).alias("_clean"), F.size(_numbers("questions")).alias("_theirs"))
    joined = repaired.withColumn("_mate", partner(F.col("name"))).join(mates, "_mate", "left")
    fresh = F.size(_numbers("before")) == 0
    keep = F.coalesce(F.col("_clean"), F.lit(False)) & (fresh | (F.size(_numbers("after")) == F.col("_theirs")))
    return joined.select("name", F.when(keep, "keep").otherwise("undo").alias("action"))


def requeue(rows: DataFrame, log: DataFrame, harmless: Sequence[str] = HARMLESS) -> tuple[DataFrame, DataFrame]:
    """Names of faulty rows, and the log without them, so that they run again."""
    names = first_by(rows, ["name"], "ord").where(F.size(F.array_except("faults", texts(harmless))) > 0).select("name")
    return names, log.join(names, "name", "left_anti")


def paired(names: DataFrame) -> DataFrame:
    """syllabus, session, variant, complete of document names: whether both sides are there."""
    d = names.select(document_name(F.col("name")).alias("d")).where("d is not null").select("d.*")
    return d.groupBy("syllabus", "session", "variant").agg((F.count_distinct("side") == 2).alias("complete"))


def hand_over(artifacts: DataFrame, rows: DataFrame, pending: DataFrame, most: int = 10, each: int = 3) -> DataFrame:
    """Pairs fit to be handed over, spread over variants.

    artifacts(paper, number, size) has pictures at both sizes; a pair fits if
    both sides hold 1 to n at both sizes, neither is pending and neither has
    a fault beyond harmless ones and staleness.
    """
    from quiresmith.operators.aggregates import stratified

    # Names are taken apart where they are a row each: by a paper's lists, not by its pictures.
    lists = artifacts.where(is_document(F.col("paper"))).groupBy("paper", "size").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    bad = pending.select("name").union(rows.where(F.size(F.array_except("faults", texts((*HARMLESS, "stale")))) > 0).select("name"))
    barred = bad.where(is_document(F.col("name"))).select(F.col("name").alias("paper"), F.lit(True).alias("bad"))
    sides = lists.withColumn("bad", F.lit(False)).unionByName(barred, allowMissingColumns=True)
    pair = ["syllabus", "session", "variant"]
    named = sides.select(*document_fields(F.col("paper")), "size", "numbers", "bad").repartition(*pair)
    four = named.groupBy(*pair, "side", "size").agg(F.array_sort(F.flatten(F.collect_list("numbers"))).alias("numbers"), F.count("numbers").alias("lists"), F.bool_or("bad").alias("bad"))
    pairs = four.groupBy(*pair).agg(F.count_if(F.col("lists") > 0).alias("n"), F.collect_set(F.when(F.col("lists") > 0, F.col("numbers"))).alias("kinds"), F.bool_or("bad").alias("bad"))
    fit = pairs.where((F.col("n") == 4) & (F.size("kinds") == 1) & ~F.col("bad")).withColumn("numbers", F.get("kinds", F.lit(0)))
    fit = fit.where(is_complete(F.col("numbers")) & (F.size("numbers") > 0))
    return stratified(fit.select(*pair, F.size("numbers").alias("questions")), "variant", ["syllabus", "session"], each, most)


def by_hand(rows: DataFrame, counts: dict[str, int] = BY_HAND) -> DataFrame:
    """name, target of rows whose items were counted by hand."""
    n = _lookup(counts, F.col("name"))
    return rows.where(n.isNotNull()).select("name", F.sequence(F.lit(1), n).alias("target"))


def second_reading(swept: DataFrame, raw: DataFrame, wanted: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc, reading, status of wanted(doc, target), and doc, page, y, number of the items that were found.

    Each document is read three ways until one finds all its numbers: in the
    band of the starts it has, along its left edge, and along that edge before
    its furniture was swept. ``reading`` is the first that did, or null, and
    then the items are the last one's. Both tables read one in the shared folder.
    """
    read = materialize(item_starts.read_thrice(swept, raw, wanted, starts), "readings")
    status = F.when(F.col("reading").isNotNull(), "cut").otherwise("could not find them all")
    return read.select("doc", "reading", status.alias("status")), read.select("doc", F.inline("found"))


def changed_counts(rows: DataFrame, log: DataFrame) -> DataFrame:
    """name, was, now of rows whose item count is not what the log has."""
    stored = log.select("name", F.col("questions").alias("was"))
    now = F.size(_numbers("questions"))
    return rows.join(stored, "name").where(now != F.col("was")).select("name", "was", now.alias("now"))
