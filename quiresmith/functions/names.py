"""The grammar of document and picture names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiresmith.functions.strings import slug, squash, tidy_tags

#: A document is <syllabus>_<session>_<side>_<variant>.
DOCUMENT = r"(?i)^([0-9]{4})_([a-z][0-9]{2})_(qp|ms)_([0-9]+)$"
ARTIFACT = r"^(.*)_q([0-9]+)$"
COPY = r" \([0-9]+\)$"
SUBJECTS = ("math", "physics", "cs", "chem", "bio")
SEASONS = ("on", "mj", "fm")
KINDS = ("Q", "MS")


def _group(name: Column, k: int) -> Column:
    return F.when(name.rlike(DOCUMENT), F.regexp_extract(name, DOCUMENT, k))


def is_document(name: Column) -> Column:
    """Whether a name is a document's."""
    return name.rlike(DOCUMENT)


def document_fields(name: Column) -> list[Column]:
    """syllabus, session, side (lower-case) and variant of a name that is a document's."""
    syllabus, session, side, variant = (F.regexp_extract(name, DOCUMENT, k) for k in range(1, 5))
    return [syllabus.alias("syllabus"), session.alias("session"), F.lower(side).alias("side"), variant.alias("variant")]


def document_name(name: Column) -> Column:
    """struct(syllabus, session, side, variant) of a document's name; null if it is none. The side is lower-case."""
    fields = [_group(name, 1).alias("syllabus"), _group(name, 2).alias("session"), F.lower(_group(name, 3)).alias("side"), _group(name, 4).alias("variant")]
    return F.when(name.rlike(DOCUMENT), F.struct(*fields))


def partner(name: Column) -> Column:
    """Name of the same document's other side; null if the name is none."""
    other = F.when(F.lower(_group(name, 3)) == "qp", "ms").otherwise("qp")
    return F.when(name.rlike(DOCUMENT), F.concat_ws("_", _group(name, 1), _group(name, 2), other, _group(name, 4)))


def pair_key(name: Column) -> Column:
    """What both sides of a document share; of any other name something of its own."""
    return F.when(name.rlike(DOCUMENT), F.concat_ws("_", _group(name, 1), _group(name, 2), _group(name, 4))).otherwise(F.concat(F.lit("!"), name))


def family(name: Column) -> Column:
    """Syllabus and first digit of the variant."""
    return F.concat(_group(name, 1), F.lit("_"), F.left(_group(name, 4), F.lit(1)))


def question_side(file: Column) -> Column:
    """A file's name with the answer side swapped for the question side."""
    return F.replace(file, F.lit("_ms_"), F.lit("_qp_"))


def artifact(stem: Column) -> Column:
    """struct(paper, number) of a picture's stem; the whole stem and null where it has no number."""
    fits = stem.rlike(ARTIFACT)
    paper = F.when(fits, F.regexp_extract(stem, ARTIFACT, 1)).otherwise(stem)
    return F.struct(paper.alias("paper"), F.when(fits, F.regexp_extract(stem, ARTIFACT, 2).try_cast("int")).alias("number"))


def subject_label(code: Column, labels: dict[str, str]) -> Column:
    """Label of a subject code; the code itself where it has none."""
    if not labels:
        return code
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, code), code)


def paper_token(paper: Column, variant: Column) -> Column:
    """p, paper and variant."""
    return F.concat(F.lit("p"), slug(paper), slug(variant))


def stem(subject: Column, paper: Column, variant: Column, chapter: Column, year: Column, season: Column, question: Column) -> Column:
    """Name of a picture without its side."""
    return F.concat_ws("_", slug(subject), paper_token(paper, variant), slug(chapter), F.concat(slug(year), slug(season)), F.concat(F.lit("q"), slug(question)))


def file_name(stem_: Column, kind: Column) -> Column:
    """Name of a picture."""
    return F.concat(stem_, F.lit("_"), kind, F.lit(".png"))


def problems(row: dict[str, Column]) -> Column:
    """Array of what a form still lacks; empty if it is fine. ``row`` has the columns of the form by name."""
    def ask(fine: Column, said: str) -> Column:
        return F.when(~F.coalesce(fine, F.lit(False)), F.lit(said))

    asked = F.array(
        ask(slug(row["subject"]).isin(*SUBJECTS), "subject"),
        ask(F.trim(row["paper"]).rlike("^[1-7]$"), "paper"),
        ask(F.trim(row["variant"]).rlike("^[0-9]$"), "variant"),
        ask(slug(row["chapter"]) != "", "chapter"),
        ask(F.trim(row["year"]).rlike("^[0-9]{4}$"), "year"),
        ask(slug(row["season"]).isin(*SEASONS), "season"),
        ask(slug(row["question"]) != "", "question"),
        ask(row["kind"].isin(*KINDS), "kind"),
    )
    return F.filter(asked, lambda x: x.isNotNull())


def sheet_values(row: dict[str, Column]) -> list[Column]:
    """Cells of a catalogue row: paper, year and marks as whole numbers where they are all digits."""
    def whole(c: Column) -> Column:
        return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("int"))

    name = stem(*(row[c] for c in ("subject", "paper", "variant", "chapter", "year", "season", "question")))
    return [
        slug(row["subject"]).alias("subject"),
        whole(row["paper"]).alias("paper"),
        squash(row["chapter"]).alias("chapter"),
        tidy_tags(row["subtopic"]).alias("subtopic"),
        whole(row["year"]).alias("year"),
        F.trim(row["difficulty"]).alias("difficulty"),
        whole(row["marks"]).alias("marks"),
        file_name(name, F.lit("Q")).alias("q_filename"),
        file_name(name, F.lit("MS")).alias("ms_filename"),
        F.trim(row["youtube_url"]).alias("youtube_url"),
    ]
