"""Journals of kits, edited by letters: each letter's line is put in, replaces a line, or is there already.

Lines are parsed by native expressions before the exchange. What a letter does hangs on the letters before it, so a kit's
lines and letters are folded in order; a letter costs a few lookups and one search among the days, not a walk over the lines:
a line that is replaced keeps its day, so the greatest day up to each place stays sorted and gives the place of a new line.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from reckon.functions import grammar as G
from reckon.functions.keys import let, revision_rank
from reckon.operators.fold import folded

#: How a stage is written in a line, and the status cell that it gives.
WRITTEN = {"code_a": "код А", "code_b": "код B", "code_c": "код C", "incoming_passed": "прошла вх контр", "sr_upload": "отпр. на загрузку в СР", "tdo_sent": "отпр на ТДО"}
STATUS = {
    "code_a": "РД Согласовано",
    "code_b": "РД_Корректировка по зам.",
    "code_c": "РД_Корректировка по зам.",
    "incoming_passed": "Прошла входной контроль",
    "sr_upload": "Отпр. на входной контроль",
    "tdo_sent": "Отпр. на входной контроль",
}
REVISION_CELL, ON_REVISION, REVISION, FILES, ABSENT, AUTO = "Рев. ", "на рев. ", "рев. ", "MTO ", "MTO Нет", "auto"
#: What may be left of a line that has a date and transmittals only.
SIGNS = r"[\s.,;:()\[\]{}\-_–—/\\]+"
CELLS, LINE, EVENT = range(3)
NO_LINE, NO_KIT = "not a line of a journal", "no kit"
FIRST = -(1 << 31)


def _one_of(stage: Column, words: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(stage == k, v) for k, v in words.items()])


def shown(revision: Column) -> Column:
    """A revision as it is written, like ``01-AN02``; empty if the text is none."""
    return let(G.sheet_revision(revision), lambda r: F.coalesce(G.revision_text(r["revision"], r["appendix"]), F.lit("")))


def same_revision(cell: Column) -> Column:
    """Equal for revisions that mean the same (``1`` and ``01``); null for a cell without one."""
    def of(r: Column) -> Column:
        rank = revision_rank(r["revision"], r["appendix"])
        text = F.concat_ws("|", F.lower(r["revision"]), F.coalesce(r["appendix"], F.lit("")))
        return F.when(r["revision"].isNotNull(), F.when(rank["rev"] < 0, text).otherwise(F.concat_ws("|", rank["rev"].cast("string"), rank["app"].cast("string"))))

    return let(G.sheet_revision(cell), of)


def line(date: Column, stage: Column, revision: Column, transmittal: Column, file_revision: Column | None = None, file_absent: Column | None = None) -> Column:
    """The line that a letter writes; null without a date or of a stage that no line tells."""
    none = F.lit(None).cast("string")
    files = shown(file_revision if file_revision is not None else none)
    absent = file_absent if file_absent is not None else F.lit(False)
    some = lambda head, text: let(text, lambda x: F.when(x != "", F.concat(head, x)))
    head = F.when(stage.startswith("code_"), ON_REVISION).otherwise(REVISION)
    return F.when(
        date.isNotNull() & stage.isin(*WRITTEN),
        F.concat_ws(" ", F.date_format(date, "dd.MM.yyyy"), _one_of(stage, WRITTEN), some(head, shown(revision)), F.nullif(F.trim(transmittal), F.lit("")), F.coalesce(some(F.lit(FILES), files), F.when(absent, ABSENT)), F.lit(AUTO)),
    )


def _parsed(text: Column) -> Column:
    """Date, day, stage, revision, transmittals, and whether the line is a stub: nothing but a date and transmittals."""
    rest = F.rtrim(F.regexp_replace(F.trim(F.regexp_extract(F.trim(text), G.DATED, 2)), G._java(G.SUFFIX), ""))
    left = F.regexp_replace(F.regexp_replace(rest, G._java(G.TRANSMITTAL), " "), SIGNS, "")

    def of(h: Column) -> Column:
        day = F.datediff(F.try_to_date(h["date"], "d.M.yyyy"), F.lit("1970-01-01").cast("date"))
        tokens = F.transform(h["transmittals"], lambda t: F.lower(t))
        stub = h["date"].isNotNull() & (h["stage"] == "other") & ((rest == "") | ((F.size(tokens) > 0) & (left == "")))
        return F.struct(h["date"].alias("date"), day.alias("day"), h["stage"].alias("stage"), F.coalesce(h["revision"], F.lit("")).alias("revision"), tokens.alias("transmittals"), stub.alias("stub"))

    return let(G.history_line(text), of)


class _Entry:
    __slots__ = ("place", "text", "date", "stage", "event", "stub")

    def __init__(self, place: tuple[int, int], row: dict):
        self.place, self.stub = place, None
        self.write(row)

    def write(self, row: dict) -> None:
        self.text, self.date, self.stage, self.event = row["line"], row["date"], row["stage"], _event(row)


def _event(row: dict) -> tuple:
    """What makes two lines the same event."""
    return row["date"], row["stage"], row["revision"], tuple(row["transmittals"])


class _Journal:
    """State of one kit: its cells, its lines in order, and where to find them."""

    def __init__(self):
        self.cells, self.lines, self.greatest, self.last, self.size, self.key = None, [], [], None, 0, ()
        self.events, self.stages = defaultdict(deque), {}
        self.stubs: dict[int, dict[tuple, deque[_Entry]]] = defaultdict(dict)

    def __call__(self, row: dict) -> list[tuple]:
        self.key = tuple(v for k, v in row.items() if k.startswith("k"))
        if row["side"] == CELLS:
            self.cells = row
            return []
        if row["side"] == LINE:
            self.read(row)
            return []
        return [(*self.key, "letter", row["id"], None, row["line"], *self.letter(row))]

    def read(self, row: dict) -> None:
        entry = _Entry((self.size, 0), row)
        self.size += 1
        self.lines.append(entry)
        self.greatest.append(max(self.greatest[-1] if self.greatest else FIRST, FIRST if row["day"] is None else row["day"]))
        if row["date"] is None:
            return
        self.last = entry
        if row["stage"] != "other":
            self.events[entry.event].append(entry)
            self.stages.setdefault((row["date"], row["stage"]), entry)
        elif row["stub"] and row["day"] is not None:
            entry.stub = (row["revision"], frozenset(row["transmittals"]))
            self.stubs[row["day"]].setdefault(entry.stub, deque()).append(entry)

    def letter(self, row: dict) -> tuple:
        """action, write_line, write_revision, write_status, revision, status, error"""
        if self.cells is None:
            return None, False, False, False, None, None, NO_KIT
        action = self.put(row)
        d, token, e = self.cells["cell"], self.cells["token"], self.cells["status"]
        newest = (self.last.date, self.last.stage) == (row["date"], row["stage"])
        differs = row["token"] != token if token is not None else d.strip() != row["cell"]
        write_d = newest and row["cell"] != "" and differs
        write_e = newest and row["status"].lower() != e.strip().lower()
        if newest:
            if row["cell"] != "":
                self.cells |= {"cell": row["cell"], "token": row["token"]}
            self.cells |= {"status": row["status"]}
        return action, action != "unchanged", write_d, write_e, self.cells["cell"], self.cells["status"], ""

    def put(self, row: dict) -> str:
        same = self.events.get(_event(row))
        if same:
            if same[0].text.strip() == row["line"]:
                return "unchanged"
            same[0].text = row["line"]
            return "replaced"
        stage = (row["date"], row["stage"])
        found = [e for e in (self.stages.get(stage), self.stub(row)) if e is not None]
        if found:
            entry = min(found, key=lambda e: e.place)
            if entry.stub is None:
                self.events[entry.event].popleft()
            else:
                self.stubs[row["day"]][entry.stub].popleft()
                entry.stub = None
                self.stages[stage] = entry
            entry.write(row)
            self.events[entry.event].append(entry)
            return "replaced"
        at = bisect_right(self.greatest, row["day"])
        end = at == len(self.lines)
        entry = _Entry((self.size, 0) if end else (self.lines[at].place[0], -1), row)
        self.lines.insert(at, entry)
        self.greatest.insert(at, row["day"])
        self.events[entry.event].append(entry)
        self.stages[stage] = entry
        if end:
            self.last = entry
        return "inserted"

    def stub(self, row: dict) -> _Entry | None:
        """The first stub of the day that says nothing else than the letter."""
        own = set(row["transmittals"])
        fits = [q[0] for (revision, tokens), q in self.stubs.get(row["day"], {}).items() if q and revision in ("", row["revision"]) and tokens <= own]
        return min(fits, key=lambda e: e.place, default=None)

    def end(self) -> list[tuple]:
        return [(*self.key, "line", None, i, e.text, *[None] * 7) for i, e in enumerate(self.lines)]


def written(cells: DataFrame, lines: DataFrame, letters: DataFrame, keys: list[str]) -> DataFrame:
    """What each letter does to its kit's journal and cells, and the journals after all of them.

    ``cells``: ``keys``, revision, status (one row a kit; of several the last by both counts). ``lines``: ``keys``, position,
    line. ``letters``: ``keys``, letter_id, position (the order of the letters), date, stage, revision, transmittal; optional
    file_revision and file_absent. Blank lines are none; letters of one position go by id.

    Rows of kind ``letter``: letter_id, line, action (inserted, replaced, unchanged), write_line, write_revision and
    write_status (what must be written), the cells after it, error. A cell is written only by a letter whose line is the last
    dated one then. A letter without a date, of a stage that no line tells (``not a line of a journal``) or of a kit without
    cells (``no kit``; null keys too) changes nothing. Rows of kind ``line``: position from 0 and line. Lines are never lost."""
    names = [f"k{i}" for i in range(len(keys))]
    own = [F.col(c).alias(n) for c, n in zip(keys, names, strict=True)]
    none = lambda k: F.lit(None).cast(k)
    optional = {c: F.col(c) for c in ("file_revision", "file_absent") if c in letters.columns}
    id_type = letters.schema["letter_id"].dataType
    text = lambda c: F.coalesce(c, F.lit(""))

    one = cells.dropna(subset=keys).groupBy(*keys).agg(F.max(F.struct(text(F.col("revision")).alias("revision"), text(F.col("status")).alias("status"))).alias("c"))
    empty = F.struct(none("string").alias("date"), none("int").alias("day"), none("string").alias("stage"), none("string").alias("revision"), none("array<string>").alias("transmittals"), none("boolean").alias("stub"))
    head = one.select(*own, F.lit(CELLS).alias("side"), F.lit(0).cast("long").alias("position"), none(id_type).alias("id"), none("string").alias("line"), empty.alias("p"), F.col("c.revision").alias("cell"), same_revision(F.col("c.revision")).alias("token"), F.col("c.status").alias("status"))
    rows = lines.filter(_all_there(keys) & (F.trim(F.regexp_replace("line", r"\s+", " ")) != "")).select(*own, F.lit(LINE).alias("side"), F.col("position").cast("long"), none(id_type).alias("id"), "line", _parsed(F.col("line")).alias("p"), *[none("string").alias(c) for c in ("cell", "token", "status")])
    shown_ = shown(F.col("revision"))
    made = letters.withColumn("__line", line(F.col("date"), F.col("stage"), F.col("revision"), F.col("transmittal"), optional.get("file_revision"), optional.get("file_absent")))
    ready = F.col("__line").isNotNull() & _all_there(keys)
    asked = made.filter(ready).select(
        *own, F.lit(EVENT).alias("side"), F.col("position").cast("long"), F.col("letter_id").alias("id"), F.col("__line").alias("line"), _parsed(F.col("__line")).alias("p"), let(shown_, lambda r: F.when(r != "", F.concat(F.lit(REVISION_CELL), r)).otherwise("")).alias("cell"), same_revision(F.col("revision")).alias("token"), _one_of(F.col("stage"), STATUS).alias("status"),
    )
    flat = lambda df: df.select(*names, "side", "position", "id", "line", "p.*", "cell", "token", "status")
    fields = [StructField("kind", StringType()), StructField("letter_id", id_type), StructField("position", IntegerType()), StructField("line", StringType()), StructField("action", StringType()), *[StructField(f"write_{c}", BooleanType()) for c in ("line", "revision", "status")], StructField("revision", StringType()), StructField("status", StringType()), StructField("error", StringType())]
    schema = StructType([*[StructField(n, cells.schema[c].dataType) for c, n in zip(keys, names, strict=True)], *fields])
    done = folded(flat(head).union(flat(rows)).union(flat(asked)), names, ["side", "position", "id", "line"], _Journal, schema)
    done = done.withColumnsRenamed(dict(zip(names, keys, strict=True)))
    refused = made.filter(~ready).select(*keys, F.lit("letter").alias("kind"), "letter_id", none("int").alias("position"), F.col("__line").alias("line"), none("string").alias("action"), *[F.lit(False).alias(f"write_{c}") for c in ("line", "revision", "status")], none("string").alias("revision"), none("string").alias("status"), F.when(F.col("__line").isNull(), NO_LINE).otherwise(NO_KIT).alias("error"))
    homeless = lines.filter(~_all_there(keys)).select(*keys, F.lit("line").alias("kind"), none(id_type).alias("letter_id"), F.col("position").cast("int").alias("position"), "line", none("string").alias("action"), *[none("boolean").alias(f"write_{c}") for c in ("line", "revision", "status")], *[none("string").alias(c) for c in ("revision", "status", "error")])
    return done.union(refused).union(homeless)


def _all_there(keys: list[str]) -> Column:
    out = F.lit(True)
    for c in keys:
        out &= F.col(c).isNotNull()
    return out
