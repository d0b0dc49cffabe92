"""License scans by conditional compression.

Every template is looked for by wording in the blocks of words around license
cues: a passage is taken only if nearly all of the template's words stand in
it, in order, and every number and license code among them. Passages are
compressed, with a few words around them, alone and with their template as a
raw zstandard dictionary. Of templates whose passages overlap, one that holds
the other's passage names the license, an exact wording comes before a variant,
and then the template that saves most. A passage taken is blanked, in all blocks, and the rest of its block is looked at
again, so that a block can hold several licenses and none spans another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import rows_of
from quiresmith.llm.license_texts import TEMPLATES, TITLES, alternatives

#: A word that every template has one of.
CUE = r"(?i)licen[cs]|copyright|permission|permitted|redistribut|public ?domain|creative commons|CC0|under the terms of the|mozilla\.org/MPL|\b[al]?gpl"
#: Words on either side of a cue that belong to its block (the longest template's, so that it fits), and the longest block that is looked at in one piece.
MARGIN, LONGEST = max(len(text.split()) for _, text in TEMPLATES), 1500
#: Words of a template that may differ, as a share; articles may always.
SLACK, ARTICLES = 0.1, frozenset({"a", "an", "the"})
_WORD = re.compile(r"\S+")
_NUMBER = re.compile(r"\(?\d{1,2}[.)]$")
_EDGES = ".,;:()[]{}<>\"'`*#/\\-–—“”‘’!?|"
_BOUND = re.compile(r"\d|\+$|^(by|cc|mit|bsd|isc|gnu|psf|python|artistic|lesser|affero|apache|mozilla|neither|endorse|not|sharealike|noncommercial)\b|attribution|^cc0$")


#: Spellings that are one, and what an address may have before and behind.
_SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed"}
_ADDRESS = re.compile(r"^https?://(?:www\.)?|(?:\.html|\.txt|\.en|/legalcode|/)+$")


def plain(word: str) -> str:
    """A word without case and the signs around it; a "+" behind it stays, and of an address what tells it."""
    word = word.lower().strip(_EDGES)
    if "/" in word:
        word = _ADDRESS.sub("", word)
    return _SPELLINGS.get(word, word)


def starts_item(text: str, spans: list[tuple[int, int]], raw: list[str], k: int) -> bool:
    """Whether a number can be that of a list's item: it starts the text or a paragraph, or follows the end of a sentence or item."""
    if k == 0 or raw[k - 1][-1] in ".:;":
        return True
    gap = text[spans[k - 1][1] : spans[k][0]]
    return gap.count("\n") > 1 or ("\n" in gap and (raw[k - 1].lower() in ("and", "or") or not plain(raw[k - 1])))


@lru_cache(maxsize=1)
def _templates() -> list[tuple[str, list[str], object, bool]]:
    """Name, words, compressor and whether it is a title, of all templates."""
    import zstandard

    out = []
    for k, (name, text) in enumerate((*TEMPLATES, *TITLES)):
        words = [p for w in text.split() if (p := plain(w))]
        data = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, words, zstandard.ZstdCompressor(level=9, dict_data=data, write_content_size=False), k >= len(TEMPLATES)))
    return out


@lru_cache(maxsize=1)
def _others() -> tuple[dict[tuple[str, ...], str], int]:
    """Licenses by the words of their identifiers and names, and the most words of any."""
    found: dict[tuple[str, ...], str] = {}
    for name, text in alternatives():
        found.setdefault(tuple(p for w in text.split() if (p := plain(w))), name)
    return found, max(map(len, found))


def _alternative(words: list[str], at: int) -> tuple[str, int] | None:
    """The license whose name stands at a place, an article aside, and the place behind it; the longest name there."""
    known, most = _others()
    at += words[at] in ARTICLES
    for n in range(min(most, len(words) - at), 0, -1):
        if name := known.get(tuple(words[at : at + n])):
            return name, at + n
    return None


def saving(t: int, words: list[str], first: int, last: int) -> int:
    """Bytes that template ``t`` saves on the words from first to last and half as many again on either side.

    In longer pieces the sizes of two streams differ by more than a short template saves.
    """
    import zstandard

    around = (last - first + 1) // 2
    piece = " ".join(words[max(0, first - around) : last + around]).encode("utf-8", "surrogatepass")
    alone = len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(piece))
    return alone - len(_templates()[t][2].compress(piece))


def may_hold(template: list[str], words: set[str]) -> bool:
    """Whether so few of a template's words are missing from a block that it could be confirmed there."""
    missing = [w for w in template if w not in words]
    return confirmed(template, (0, 0, missing, []))


@lru_cache(maxsize=1)
def _by_word() -> tuple[dict[str, list[int]], list[int]]:
    """Templates by the first of their words that may not be missing, and those without such a word."""
    found: dict[str, list[int]] = {}
    free = []
    for t, (_, template, _, _) in enumerate(_templates()):
        word = next((w for w in template if _BOUND.search(w)), None)
        if word is None:
            free.append(t)
        else:
            found.setdefault(word, []).append(t)
    return found, free


def _possible(words: set[str]) -> list[int]:
    """Templates in their order that have nothing bound that a block has not, as far as their first such word tells."""
    found, free = _by_word()
    return sorted([*free, *(t for w in words & found.keys() for t in found[w])])


def differences(template: list[str], words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
    """Where a template stands in a block (first, past last), its missing words and the extra ones; None if it does not."""
    # A passage starts with one of the template's first words: more may not be missing.
    heads, left = set(), int(SLACK * len(template)) + 1
    for w in template:
        heads.add(w)
        left -= w not in ARTICLES
        if not left:
            break
    best = None
    for at in (k for k, w in enumerate(words) if w in heads):
        window = words[at : at + 2 * len(template) + 8]
        if not may_hold(template, set(window)):
            continue
        match = SequenceMatcher(None, template, window, autojunk=False)
        blocks = [b for b in match.get_matching_blocks() if b.size]
        if not blocks:
            continue
        first, last = at + blocks[0].b, at + blocks[-1].b + blocks[-1].size
        kept = {i for b in blocks for i in range(b.a, b.a + b.size)}
        used = {at + i for b in blocks for i in range(b.b, b.b + b.size)}
        missing = [w for i, w in enumerate(template) if i not in kept]
        extra = [words[i] for i in range(first, last) if i not in used]
        # Differences that are allowed come before fewer that are not.
        found = (not confirmed(template, (first, last, missing, extra)), len(missing) + len(extra), first, last, missing, extra)
        if best is None or found[:2] < best[:2]:
            best = found
        if best[:2] == (False, 0):
            break
    return best[2:] if best else None


def confirmed(template: list[str], found: tuple[int, int, list[str], list[str]]) -> bool:
    """Whether differences leave the license what it is."""
    _, _, missing, extra = found
    if any(not w or _BOUND.search(w) for w in (*missing, *extra)):  # a blanked word is another passage's
        return False
    return all(sum(w not in ARTICLES for w in side) <= SLACK * len(template) for side in (missing, extra))


def _named_by(hits: list[tuple]) -> tuple:
    """The hit (license, first, past last, missing, extra, saved) that names its passage.

    A passage that lies within another's is a part of that one's wording (as a
    plain notice is of an or-later one), so it names nothing. Of the others an
    exact wording comes before a variant, then what saves most; of equals the
    first in the table.
    """
    whole = [h for h in hits if not any(o[1] <= h[1] and h[2] <= o[2] and o[2] - o[1] > h[2] - h[1] for o in hits)]
    return min(whole, key=lambda h: (bool(h[3] or h[4]), -h[5]))


def scan(text: str | None) -> list[dict]:
    """Licenses of a text: name, first and past-last character, exact or variant, bytes saved, missing and extra words."""
    text = text or ""
    spans = [m.span() for m in _WORD.finditer(text)] if re.search(CUE, text) else []
    raw = [text[a:b] for a, b in spans]
    listed = {k for k in range(len(raw)) if _NUMBER.match(raw[k]) and starts_item(text, spans, raw, k)}
    cues = [k for k, w in enumerate(raw) if re.search(CUE, w) or (w.lower() in ("public", "creative"))]
    out: list[dict] = []
    blocks: list[list[int]] = []
    for k in cues:
        first, last = max(0, k - MARGIN), min(len(raw), k + MARGIN + 1)
        if blocks and first <= blocks[-1][1] and last - blocks[-1][0] <= LONGEST:
            blocks[-1][1] = last
        else:
            # A block that grew too long goes on in the next, which starts a template's length before.
            blocks.append([first, last])
    blank: set[int] = set()
    for first, last in blocks:
        places = [k for k in range(first, last) if plain(raw[k]) and k not in listed]
        words = ["" if k in blank else plain(raw[k]) for k in places]
        some = set(words)
        fits = [t for t in _possible(some) if may_hold(_templates()[t][1], some)]
        while True:
            hits, held = [], set(words)
            for t in fits:
                name, template, _, title = _templates()[t]
                found = differences(template, words) if may_hold(template, held) else None
                if found and confirmed(template, found) and not (title and (found[2] or found[3] or not _own_line(text, spans[places[found[0]]][0], spans[places[found[1] - 1]][1]))):
                    hits.append((name, *found, saving(t, words, *found[:2])))
            if not hits:
                break
            name, a, b, missing, extra, saved = _named_by(hits)
            out.append({"license": name, "start": spans[places[a]][0], "end": spans[places[b - 1]][1], "wording": "variant" if missing or extra else "exact", "saved_bytes": saved, "missing": " ".join(missing), "extra": " ".join(extra)})
            words[a:b] = [""] * (b - a)
            blank.update(places[a:b])
            # "... or B": what a passage goes on with names another license.
            while b + 1 < len(words) and words[b] in ("or", "and") and (more := _alternative(words, b + 1)):
                name, past = more
                out.append({"license": name, "start": spans[places[b + 1]][0], "end": spans[places[past - 1]][1], "wording": "exact", "saved_bytes": 0, "missing": "", "extra": ""})
                words[b:past] = [""] * (past - b)
                blank.update(places[b:past])
                b = past
    return sorted(out, key=lambda r: (r["start"], r["end"], r["license"]))


def _own_line(text: str, start: int, end: int) -> bool:
    """Whether only signs stand beside a passage on its first and last line."""
    head, tail = text[:start].rpartition("\n")[2], text[end:].partition("\n")[0]
    return not any(map(plain, (head + " " + tail).split()))


_ROW = "license string, start int, end int, wording string, saved_bytes int, missing string, extra string"


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, license, start, end, wording, saved_bytes, missing, extra for docs(doc_id, text): a row per passage found.

    Whole texts of any length are scanned; those without any cue never leave
    the JVM. Null and empty texts and empty tables have no rows; null ids and
    repeated rows stay as they are. Where templates fit one passage, the one
    with the longest wording there names it, an exact wording before a
    variant, then what saves most; of equals the first in the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _ROW.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in rows_of(batches):
            at, found = [], []
            for k, text in enumerate(batch.column(1)):
                for r in scan(text.as_py()):
                    at.append(k)
                    found.append(r)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.record_batch([ids, *(pa.array([r[n] for r in found], t) for n, t in zip(names, kinds))], ["doc_id", *names])

    kind = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(_ROW)])
    return docs.select("doc_id", "text").where(F.col("text").rlike(CUE)).mapInArrow(run, kind)
