"""Schemas of the tables that the engine reads."""

from __future__ import annotations

SPAN = "doc string, page int, ord int, left double, centre double, y double, text string"
BLOCK = "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string"
PAGE = "doc string, page int, width double, height double, rotation int"
PLACEMENT = "doc string, page int, x0 double, y0 double, x1 double, y1 double"
PIXEL_ROW = "img string, y int, px array<int>"
START = "doc string, page int, y double, number int"
INVENTORY = "path string, name string"
ARTIFACT = "folder string, file string, paper string, number int, bytes bigint"
DETAIL = (
    "rotations: array<int>, missing_part: array<struct<question: int, starts_at: string>>, foreign: array<struct<question: int, found: array<array<int>>>>, "
    "furniture: struct<page: int, text: string>, clipped: array<array<string>>, stale: struct<on_disk: int, now: int>, pair: struct<qp: int, ms: int>, error: string"
)
AUDIT = f"name string, kind string, questions array<int>, faults array<string>, detail struct<{DETAIL}>"
BATCH_LOG = "paper string, name string, status string, questions int, pages_in int, pages_out int, error string, seconds double"
REPAIR_LOG = "name string, target array<int>, target_from string, kind string, before array<int>, after array<int>, written int, status string, error string"
MATCHUP_LOG = "name string, target array<int>, before array<int>, after array<int>, images int, status string, error string"
RECUT_LOG = "name string, was int, now int, written int, error string"
FAMILY = "family string, questions int, share double, papers bigint, seen map<int, bigint>, certain boolean"
CATALOG = "subject string, paper string, chapter string, subtopic string, year string, difficulty string, marks string, q_filename string, ms_filename string, youtube_url string"
SHEET_CELL = "sheet string, row int, col int, value string"
#: Spellings of the catalogue's headings.
HEADINGS = {
    "subject": ("subject",),
    "paper": ("paper", "paperno", "papernumber"),
    "chapter": ("chapter", "topic", "chaptername"),
    "subtopic": ("subtopic", "subtopics", "subchapter", "subchapters", "subtopicname", "section"),
    "year": ("year", "examyear"),
    "difficulty": ("difficulty", "level"),
    "marks": ("marks", "totalmarks", "mark"),
    "q_filename": ("qfilename", "questionfilename", "qfile", "questionfile"),
    "ms_filename": ("msfilename", "markschemefilename", "msfile", "markschemefile"),
    "youtube_url": ("youtubeurl", "youtube", "video", "videourl", "solutionvideo"),
}
