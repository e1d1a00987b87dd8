"""Replies to letters as text, read by native expressions: what the answer on top says, and which kit the thread is about.

Only the text above the first quoted letter says what happened; the kit may be named there, in the quoted letters, or in prose.
A reply that names no kit is left to :mod:`reckon.operators.replies`, which looks its transmittal up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reckon.functions import grammar as G
from reckon.functions import letters as L
from reckon.functions.keys import let

#: Where a quoted letter begins, names with a revision, bare kits, kits in prose, words of the answers.
QUOTED = r"(?i)\nFrom:\s"
STEM = r"(?iu)(%s\.\d{3,4}-(\d{4})-([a-zA-Zа-яА-Я]{2,5}\d{0,2}(?:\.\d)?)\.([a-zA-Zа-яА-Я0-9]{2,5})-\d{4}(?:\.\d{1,2})?)(?:_(\d{1,2}(?:-AN\d{1,2})?|[VS])(?:_(?:RU|EN|ER))?)?"
KIT = r"(?i)(%s\.287-(\d{4})-([A-Za-z0-9]+))"
PROSE = r"(?iu)титул[ауе]?\s+(?:%s\.287-)?(\d{4})(?:\s*-\s*[A-Za-z0-9.]+)?[\s,;]*марка\s+([A-Za-z0-9.]+)[\s,;]*рев\.?\s*(\d{1,2}(?:-AN\d{1,2})?|[A-Z])(?![A-Za-z0-9А-Яа-я])"
PROSE_NAME = r"(?iu)титул[ауе]?\s+%s\.287-(\d{4})-([A-Za-z0-9.]+)\s*_(\d{1,2}(?:-AN\d{1,2})?|[A-Z])(?![A-Za-z0-9А-Яа-я])"
ACCEPTED = r"(?iu)(?:документац[\p{L}\d_]*|документы)\s+принят"
LOADED = r"(?iu)(?:документац[\p{L}\d_]*|документы)\s+загружен"
UPLOADED = ("загруз", "ср")
SENT_ON = ("направлен", "на рассмотрение")
UNDER_REVIEW = "на рассмотрении"
#: Errors of a reply; an unknown kit may still be found by its transmittal.
SEVERAL, NO_KIT, UNKNOWN = "several kits", "no kit of documents", "unknown kit"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _one_of_each(documents: Column) -> Column:
    """The first of each name, with the first revision that any of them has."""
    same = lambda d: F.filter(documents, lambda x: F.lower(x["name"]) == F.lower(d["name"]))
    names = F.transform(documents, lambda d: F.lower(d["name"]))
    first = F.filter(documents, lambda d, i: F.array_position(names, F.lower(d["name"])) == i + 1)
    return F.transform(first, lambda d: d.withField("revision", F.coalesce(F.get(F.filter(same(d), lambda x: x["revision"] != ""), F.lit(0))["revision"], F.lit(""))))


def documents(text: Column, contract: str) -> Column:
    """(name, title, mark, od, revision) of the document names in a text; of bare kits if it has none."""
    stem, kit = STEM % contract, KIT % contract

    def of(pattern: str, od: bool):
        take = lambda m, g: F.regexp_extract(m, pattern, g)
        return lambda m: F.struct(
            take(m, 1).alias("name"), take(m, 2).alias("title"), F.upper(take(m, 3)).alias("mark"), (F.upper(take(m, 4)) == "OD" if od else F.lit(False)).alias("od"), (take(m, 5) if od else F.lit("")).alias("revision"),
        )

    named = F.transform(_matches(text, stem), of(stem, True))
    return let(named, lambda n: F.when(F.size(n) > 0, let(n, _one_of_each)).otherwise(let(F.transform(_matches(text, kit), of(kit, False)), _one_of_each)))


def prose(text: Column, contract: str) -> Column:
    """(title, mark, revision) of the one kit that a text names in prose, else null; revisions that differ give none."""
    def of(pattern: str):
        return F.transform(_matches(text, pattern), lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("title"), F.upper(F.regexp_extract(m, pattern, 2)).alias("mark"), F.regexp_extract(m, pattern, 3).alias("revision")))

    def one(found: Column) -> Column:
        kits = F.array_distinct(F.transform(found, lambda x: F.struct(x["title"], x["mark"])))
        revisions = F.array_distinct(F.transform(found, lambda x: x["revision"]))
        first = F.get(found, F.lit(0))
        return F.when(F.size(kits) == 1, first.withField("revision", F.when(F.size(revisions) == 1, first["revision"]).otherwise("")))

    return let(F.concat(of(PROSE % contract), of(PROSE_NAME % contract)), one)


def kits_of(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda d: F.struct(d["title"], d["mark"])))


def _revision(found: Column) -> Column:
    """That of the first OD document, else the first that any document has; empty if there is none."""
    return F.coalesce(F.get(F.filter(found, lambda d: d["od"]), F.lit(0))["revision"], F.get(F.filter(found, lambda d: d["revision"] != ""), F.lit(0))["revision"], F.lit(""))


def said(top: Column, incoming: Column) -> Column:
    """The stage that an answer reports; null if it reports none."""
    low = F.lower(top)
    both = lambda words: low.contains(words[0]) & low.contains(words[1])
    loaded = F.when(incoming.isNotNull(), "incoming_passed").otherwise("sr_upload")
    return F.when(both(UPLOADED), loaded).when(both(SENT_ON) | low.contains(UNDER_REVIEW) | top.rlike(ACCEPTED), "incoming_passed").when(top.rlike(LOADED), loaded)


def _from_table(found: Column, body: Column, contract: str) -> Column:
    """Documents without any revision take those of the quoted table."""
    def fill(table: Column) -> Column:
        of = lambda d: F.get(F.filter(table, lambda x: F.lower(x["name"]) == F.lower(d["name"])), F.lit(0))["revision"]
        return F.transform(found, lambda d: d.withField("revision", F.coalesce(of(d), F.lit(""))))

    return F.when((F.size(found) == 0) | F.exists(found, lambda d: d["revision"] != ""), found).otherwise(let(L._first_of_each(L._documents(body, L.SENT, contract, False)), fill))


def reply(subject: Column, body: Column, contract: str = "[A-Z]{4}") -> Column:
    """transmittal, incoming, stage, title, mark, revision, documents, error.

    ``transmittal``: the first of the subject; ``incoming``: the first other one of the answer. The kit is that of the
    documents in the answer, else of those in the thread if they are of one kit, else the one that prose names. The revision
    is that of the first OD document, else the first one, else the prose's if its kit is the same. Several kits and marks that
    are no kit are errors; without a kit the error is ``unknown kit``. Null texts are empty."""
    text = lambda c: G.dashes(F.coalesce(c, F.lit("")))

    def settled(found: Column, told: Column, send: Column, incoming: Column, stage: Column) -> Column:
        kits = kits_of(found)
        own = F.get(kits, F.lit(0))
        title, mark = F.coalesce(own["title"], told["title"]), F.coalesce(own["mark"], told["mark"])
        named, one = _revision(found), F.size(kits) <= 1
        revision = F.when(named != "", named).when(one & (title == told["title"]) & (mark == told["mark"]), told["revision"])
        error = F.when(F.size(kits) > 1, SEVERAL).when(title.isNull(), UNKNOWN).when(~G.is_mark(mark), NO_KIT).otherwise("")
        return F.struct(
            send.alias("transmittal"), incoming.alias("incoming"), stage.alias("stage"), F.when(one, title).alias("title"), F.when(one, mark).alias("mark"), F.nullif(revision, F.lit("")).alias("revision"), F.size(found).alias("documents"), error.alias("error"),
        )

    def told(found: Column, b: Column) -> Column:
        """Prose is read where documents leave the kit or its revision open."""
        return F.when(_revision(found) == "", prose(b, contract))

    def of(s: Column, b: Column) -> Column:
        top = F.regexp_replace(F.get(F.split(b, QUOTED, 2), F.lit(0)), r"^\s+|\s+$", "")
        send = F.regexp_extract(s, L.TRANSMITTAL, 0)

        def answered(top: Column, send: Column) -> Column:
            incoming = F.get(F.filter(_matches(top, L.TRANSMITTAL), lambda t: F.lower(t) != F.lower(send)), F.lit(0))
            thread = let(documents(b, contract), lambda d: F.when(F.size(kits_of(d)) == 1, d).otherwise(F.slice(d, 1, 0)))
            found = let(documents(top, contract), lambda d: F.when(F.size(d) > 0, d).otherwise(thread))
            return let(incoming, lambda i: let(found, lambda d: let(_from_table(d, b, contract), lambda d: let(told(d, b), lambda p: settled(d, p, F.nullif(send, F.lit("")), i, said(top, i))))))

        return let(top, lambda t: let(send, lambda x: answered(t, x)))

    return let(F.trim(text(subject)), lambda s: let(F.replace(text(body), F.lit("\r\n"), F.lit("\n")), lambda b: of(s, b)))
