"""Grammars of document names, transfer folders, revisions, history lines and tags, as Column functions.

Each returns a struct; a part that a text doesn't have is null. Patterns use no look-around, so every regex engine reads them
alike. Fixed values: the patterns, stage keys and alias tables below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reckon.functions.keys import let

#: Dashes that stand for the hyphen.
DASHES = "‐‑‒–—―⁃−﹘﹣－"
#: A document name: contract, title and system, discipline, sheet, revision tail. The contract's letters are a parameter.
TITLE_SYSTEM = r"\d{4}-[a-zA-Zа-яА-Я]{2,5}\d{0,2}(?:\.\d)?"
REVISION_TAIL = r"_(?:\d{1,2}(?:-AN\d{1,2})?|[VS])_(?:RU|EN|ER)\.[a-zA-Z]{3,5}"
TAIL_PARTS = r"^_(\d{1,2}|[VS])(?:-AN(\d{1,2}))?_(RU|EN|ER)\.([a-zA-Z]{3,5})"
STRICT = r"(%s\.\d{3,4})-(" + TITLE_SYSTEM + r")\.([a-zA-Zа-яА-Я0-9]{2,5}-\d{4})(?:\.(\d{1,2}))?(" + REVISION_TAIL + ")?"
LOOSE = r"(%s\.\d{3,4})-(" + TITLE_SYSTEM + r")\.([a-zA-Zа-яА-Я0-9]{2,5}(?:-\d{4})?)(?:\.(\d{1,2}))?(\.[a-zA-Z]{3,5})?(" + REVISION_TAIL + ")?"
#: Transfer folders.
SEQUENCE = r"^\s*(\d{1,2})(?:\D|$)"
FOLDER_REVISION = r"(?i)(?:рев(?:изия)?|rev(?:ision)?)\s*[._:\-]?\s*(\d{1,2}|[VS])(?:\s*-\s*AN\s*(\d{1,2}))?"
AS_BUILD = r"(?i)(?:as[\s_.-]*built?|исполнит(?:ельн(?:ая|ой|ые))?)"
VOID = r"(?i)(?:^|[_\-\s.])void(?:$|[_\-\s.])"
GATE = r"(?i)передач|отправк"
#: Revision cells, history lines.
REVISION_PREFIX = r"(?i)^(?:рев\.?|revision)\s*"
REVISION_BODY = r"(?i)(\d{1,2}|[VS])(?:-AN(\d{1,2}))?"
DATED = r"^(\d{1,2}\.\d{1,2}\.\d{4})\s*(.*)$"
REVISION_IN_TEXT = r"(?i)рев\.?\s*(\d{1,2}(?:-AN\d{1,2})?|[VS]|[A-Z])"
TRANSMITTAL = r"(?i)[A-Z0-9]+(?:[.-][A-Z0-9]+)*-TRM-\d+"
SUFFIX = r"(?i)(?:^|\s+)(?:MTO\s+(?:(Нет)|(\d{1,2}(?:-AN\d{1,2})?|[VS]|[A-Z]))(?:\s+(auto))?|(auto))\s*$"
STAGES = (
    ("code_a", r"(?i)код\s*[аa]"),
    ("code_c", r"(?i)код\s*[cс](?:[^a-zа-яё]|$)"),
    ("code_b", r"(?i)код\s*[бbв]"),
    ("sr_upload", r"(?i)загрузк[\wа-яё]*.{0,20}ср|отпр[\wа-яё]*.{0,20}на\s+загр"),
    ("tdo_passed", r"(?i)прош[\wа-яё]*\s+тдо"),
    ("tdo_sent", r"(?i)отпр[\wа-яё]*\s+на\s+тдо"),
    ("incoming_sent", r"(?i)отпр[\wа-яё]*.{0,20}(?:вх|входн)"),
    ("incoming_passed", r"(?i)прош[\wа-яё]*.{0,16}(?:вх|входн)|вх\s*контр|входн[\wа-яё]*\s+контр"),
    ("dup", r"(?i)(?:^|[^\wа-яё])дуп(?:[^\wа-яё]|$)"),
    ("correction", r"(?i)корректир"),
    ("agreed", r"(?i)соглас"),
    ("us_build", r"(?i)us[\s_.-]*build|as[\s_.-]*built?"),
)
#: Marks.
MARK = r"^[A-Za-z]{2,5}\d{0,2}(?:\.\d{1,2})?$"
MARK_ALIASES = {"ксб": "KSB", "пд": "PD"}
NO_MARKS = ("интерфейс", "расст. камер", "расст камер", "комментарии", "nanocad", "то", "мдз", "ид")
#: Tags in text: field equipment, then boxes.
TAGS = (
    r"\d{4}(?:-[A-ZА-Я]{2,3}-\d{2})?-[A-ZА-Я]-[a-zA-Zа-яА-Я]{1,5}-\d{4}(?:\((?:[EЕ][xXхХ]|IS)\))?(?:-\d{2}-[a-zA-Zа-яА-Я]{2,5}-\d{3})?",
    r"\d{4}-[A-Z]{3}-\d{3}-[a-zA-Zа-яА-Я]{2,5}-\d{3}",
)


def _java(pattern: str) -> str:
    """Java folds the case of letters beyond ASCII only when asked to."""
    return pattern.replace("(?i)", "(?iu)")


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null where it matched nothing."""
    return F.nullif(F.regexp_extract(text, _java(pattern), group), F.lit(""))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(_java(pattern))


def dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def document(name: Column, contract: str = "[A-Z]{4}", loose: bool = False) -> Column:
    """Parts of the first document name in a text; a loose one may lack the number and have a plain extension."""
    pattern = (LOOSE if loose else STRICT) % contract
    own = lambda x: F.struct(part(x, pattern, 1).alias("contract"), part(x, pattern, 2).alias("title_system"), part(x, pattern, 3).alias("discipline"), part(x, pattern, 4).alias("sheet"), (part(x, pattern, 5) if loose else F.lit(None).cast("string")).alias("extension"), part(x, pattern, 6 if loose else 5).alias("tail"))
    return let(dashes(name), lambda x: F.when(x.rlike(pattern), own(x)))


def revision_tail(tail: Column) -> Column:
    """Revision, appendix, language and file type of a tail like ``_01-AN02_RU.doc``."""
    return let(dashes(tail), lambda x: F.struct(*[part(x, TAIL_PARTS, i).alias(n) for i, n in enumerate(("revision", "appendix", "language", "file_type"), 1)]))


def folder(name: Column, under_gate: bool = False) -> Column:
    """A transfer folder: sequence, revision, appendix, title and mark, flags, and whether it is an issued package."""
    x = dashes(name)
    bare, seq = F.trim(x), part(F.trim(x), SEQUENCE, 1)
    strip = lambda c: F.regexp_replace(c, r"^[ ._-]+|[ ._-]+$", "")
    rest = strip(F.regexp_replace(bare, r"^\s*\d{1,2}", ""))
    rest = strip(F.regexp_replace(strip(F.regexp_replace(rest, _java(AS_BUILD), "")), _java(VOID), ""))
    gate = has(bare, GATE)
    issued = seq.isNotNull() & ~bare.rlike(r"^\d{4}$") & (F.lit(True) if under_gate else ~gate & (has(bare, FOLDER_REVISION) | (rest == "")))
    title = part(x, f"({TITLE_SYSTEM})", 1)
    return F.struct(
        seq.cast("int").alias("sequence"), part(x, FOLDER_REVISION, 1).alias("revision"), part(x, FOLDER_REVISION, 2).alias("appendix"), F.split_part(title, F.lit("-"), F.lit(1)).alias("title"),
        F.regexp_replace(title, r"^\d+-", "").alias("mark"), has(x, AS_BUILD).alias("as_build"), has(x, VOID).alias("void"), gate.alias("gate"), issued.alias("issued"),
    )


def sheet_revision(cell: Column) -> Column:
    """(revision, appendix) of a cell: digits to two places, a single letter in upper case."""
    raw = F.regexp_replace(F.regexp_replace(F.trim(dashes(F.coalesce(cell, F.lit("")))), "АН", "AN"), "ан", "AN")

    def of(raw: Column, found: Column) -> Column:
        number = found.try_cast("int")
        digits = F.when(number == 0, "0").when(number.isNotNull(), F.lpad(number.cast("string"), 2, "0")).otherwise(found)
        letter = F.when(raw.rlike("^[A-Za-z]$"), F.upper(raw))
        return F.struct(F.when(found.isNotNull(), digits).otherwise(letter).alias("revision"), F.when(found.isNotNull(), part(raw, REVISION_BODY, 2)).alias("appendix"))

    return let(F.trim(F.regexp_replace(raw, _java(REVISION_PREFIX), "")), lambda raw: let(part(raw, REVISION_BODY, 1), lambda found: of(raw, found)))


def revision_text(revision: Column, appendix: Column) -> Column:
    """``01-AN02``; without a revision empty."""
    return F.when(F.coalesce(revision, F.lit("")) == "", "").when(F.coalesce(appendix, F.lit("")) == "", revision).otherwise(F.concat(revision, F.lit("-AN"), appendix))


def stage(text: Column) -> Column:
    """Key of the first stage whose pattern the text has."""
    found = F.coalesce(*[F.when(has(text, p), F.lit(k)) for k, p in STAGES])
    return F.coalesce(found, F.lit("other"))


def history_line(line: Column) -> Column:
    """Date, stage, revision, transmittals and the trailing file-revision mark of a line of history."""

    def parts(date: Column, rest: Column, core: Column, own: Column, file: Column) -> Column:
        return F.struct(
            date.alias("date"), stage(core).alias("stage"), own["revision"].alias("revision"), own["appendix"].alias("appendix"), F.array_distinct(F.regexp_extract_all(core, F.lit(_java(TRANSMITTAL)), F.lit(0))).alias("transmittals"),
            file["revision"].alias("file_revision"), part(rest, SUFFIX, 1).isNotNull().alias("file_absent"), (part(rest, SUFFIX, 3).isNotNull() | part(rest, SUFFIX, 4).isNotNull()).alias("automatic"),
        )

    def dated(raw: Column, date: Column) -> Column:
        rest = F.when(date.isNotNull(), F.trim(F.regexp_extract(raw, DATED, 2))).otherwise(raw)
        rest = F.regexp_replace(F.regexp_replace(dashes(rest), "АН", "AN"), "ан", "AN")
        return let(rest, lambda rest: let(F.rtrim(F.regexp_replace(rest, _java(SUFFIX), "")), lambda core: let(sheet_revision(part(core, REVISION_IN_TEXT, 1)), lambda own: let(sheet_revision(part(rest, SUFFIX, 2)), lambda file: parts(date, rest, core, own, file)))))

    return let(F.trim(F.coalesce(line, F.lit(""))), lambda raw: let(part(raw, DATED, 1), lambda date: dated(raw, date)))


def mark(cell: Column) -> Column:
    """A mark without its issue suffix, aliases in Latin letters."""
    bare = F.regexp_replace(F.trim(F.coalesce(cell, F.lit(""))), r"(?i)_IF[CR]$", "")
    return reduce(lambda out, x: F.when(F.lower(bare) == x[0], x[1]).otherwise(out), MARK_ALIASES.items(), bare)


def is_mark(c: Column) -> Column:
    """Whether a kit has this mark: Latin letters, no drawing model, not on the list of other sheets."""
    return c.rlike(MARK) & ~F.lower(c).isin(*NO_MARKS) & ~F.lower(c).contains("3d")


def tags_in(text: Column) -> Column:
    """All tags of a text: field equipment first, then boxes."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in TAGS])


def tag(c: Column) -> Column:
    """Parts of a tag ``wbs[-building-number]-system-equipment-sequence[(code)]``; valid from three parts on."""
    p = F.split(c, "-")
    n = F.size(p)
    last = F.element_at(p, -1)
    sequence = F.split_part(last, F.lit("("), F.lit(1))
    code = F.when(last.contains("("), F.regexp_replace(F.trim(F.split_part(last, F.lit("("), F.lit(2))), r"^\)+|\)+$", ""))
    at = lambda i, ok: F.when(ok, F.get(p, i))
    whole = n >= 3
    return F.struct(
        whole.alias("valid"), at(F.lit(0), whole).alias("wbs"), at(F.lit(1), n == 6).alias("building"), at(F.lit(2), n == 6).alias("building_number"), at(n - 3, whole).alias("system"), at(n - 2, whole).alias("equipment"),
        F.when(whole, sequence).alias("sequence"), F.when(whole, code).alias("code"), F.when(whole & (F.length(sequence) >= 2), F.substring(sequence, 1, 1)).alias("floor"), F.when(whole & (F.length(sequence) >= 2), F.substring(sequence, 2, 1)).alias("subsystem"),
    )


def composite_title(c: Column) -> Column:
    """(title, system) of a whole text like ``8950-SOO1``; null parts otherwise."""
    x = F.trim(F.coalesce(c, F.lit("")))
    whole = r"^(\d{4})-([a-zA-Zа-яА-Я]{2,5}\d{0,2}(?:\.\d)?)$"
    return F.struct(part(x, whole, 1).alias("title"), part(x, whole, 2).alias("system"))
