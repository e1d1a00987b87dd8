"""Letters as text: notifications of review codes and cover letters, read by native expressions.

A letter is cut where its document lines begin; within the piece of a document its own fields are looked up, so a field never
comes from another document's lines. What can't be told is an error in the result, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reckon.functions import grammar as G
from reckon.functions.keys import let

#: How letters say what they are, and how they write transmittals, dates, documents and codes.
NOTIFICATION = r"(?iu)Notification of Transmittal Number\s+'([^']+)'"
NOTIFIED = "transmittal notification"
COVER = r"(?iu)сопроводительн[\p{L}\d_]*\s+письм"
COVER_BODY = r"(?ius)please\s+find\s+attached\s+transmittals|owner\s+document\s+number|документац[\p{L}\d_]*.{0,80}комплект|направляем[\p{L}\d_]*.{0,80}документ"
REPLY = r"(?iu)^(?:re|отв(?:ет)?)\s*[:：]"
TRANSMITTAL = r"(?i)[A-Z0-9]+(?:[.-][A-Z0-9]+)*-TRM-\d+"
DATED = r"(?i)Transmittal Date\s+(\d{1,2}\.\d{1,2}\.\d{4})"
NAME = r"%s\.287-\d{4}-[A-Za-z0-9.]+(?:\.[A-Za-z0-9.-]+)*"
REVIEWED = r"(?i)(?:^|[\n\t ])\s*\d+\.\s+(" + NAME + r")\s*\\\s*(\d+(?:-AN\d+)?|[A-Z])\s*\\"
SENT = r"(?i)(?:^|[\n\t ])\s*\d+\s+(" + NAME + r")\s+(\d{1,2}(?:-AN\d{1,2})?|[A-Z])(?![A-Za-z0-9-])"
VERDICT = r"(?iu)\\\s*([ABC])\s*-\s*(?:Замечания отсутствуют|Незначительные|Существенные|Критические)"
#: A sign that no letter has.
CUT = "\x01"


def _pieces(body: Column, start: str) -> Column:
    """The body from each document line to the next."""
    return F.filter(F.split(F.regexp_replace(body, f"({start})", CUT + "$1"), CUT), lambda x: x.rlike(start))


def _documents(body: Column, start: str, contract: str, coded: bool) -> Column:
    """(name, title, mark, od, revision, code) of each document line that holds a document name."""
    start, strict = start % contract, G.STRICT % contract

    def of(piece: Column) -> Column:
        codes = F.regexp_extract_all(piece, F.lit(VERDICT), F.lit(1))
        code = F.when(F.size(codes) > 0, F.upper(F.element_at(codes, F.lit(-1)))) if coded else F.lit(None).cast("string")
        parts = lambda name: F.struct(name.alias("name"), F.regexp_extract(name, strict, 2).alias("title_system"), F.regexp_extract(name, strict, 3).alias("discipline"))
        return let(let(F.regexp_extract(piece, start, 1), parts), lambda d: F.struct(
            d["name"].alias("name"), F.substring(d["title_system"], 1, 4).alias("title"), F.upper(F.substring(d["title_system"], 6, 99)).alias("mark"), F.upper(d["discipline"]).startswith("OD-").alias("od"), F.regexp_extract(piece, start, 2).alias("revision"), code.alias("code"),
        ))

    return F.filter(F.transform(_pieces(body, start), of), lambda d: d["title"] != "")


def _first_of_each(documents: Column) -> Column:
    """Bound first: inside the filter the documents and their names would be read again for each of them."""
    return let(documents, lambda ds: let(F.transform(ds, lambda d: F.lower(d["name"])), lambda names: F.filter(ds, lambda d, i: F.array_position(names, F.lower(d["name"])) == i + 1)))


def _commonest(codes: Column) -> Column:
    """The code that most documents have, the first of equals."""
    counted = F.transform(F.array_distinct(codes), lambda c, i: F.struct(F.size(F.filter(codes, lambda x: x == c)).alias("n"), (-i).alias("back"), c.alias("code")))
    return F.array_max(counted)["code"]


def _letter(kind: str, documents: Column, trm: Column, date: Column) -> Column:
    def of(d: Column) -> Column:
        kits = F.array_distinct(F.transform(d, lambda x: F.struct(x["title"], x["mark"])))
        od = F.filter(d, lambda x: x["od"])
        codes = F.array_compact(F.transform(d, lambda x: x["code"]))
        mark = F.get(kits, F.lit(0))["mark"]
        error = F.when(F.size(d) == 0, "no documents").when(F.size(kits) > 1, "several kits").when(~G.is_mark(mark), "no kit of documents").otherwise("")
        one = F.size(kits) == 1
        code = F.coalesce(F.get(od, F.lit(0))["code"], _commonest(codes))
        stage = F.concat(F.lit("code_"), F.lower(code)) if kind == "review codes" else F.lit("tdo_sent")
        letters = F.transform(F.array_sort(F.array_distinct(F.transform(d, lambda x: F.coalesce(x["code"], F.lit("?"))))), lambda c: F.concat(c, F.lit("="), F.size(F.filter(d, lambda x: F.coalesce(x["code"], F.lit("?")) == c)).cast("string")))
        return F.struct(
            F.lit(kind).alias("kind"), F.nullif(trm, F.lit("")).alias("transmittal"), date.alias("date"), F.when(one, F.get(kits, F.lit(0))["title"]).alias("title"), F.when(one, mark).alias("mark"),
            F.coalesce(F.get(od, F.lit(0))["revision"], F.get(d, F.lit(0))["revision"]).alias("revision"), F.when(error == "", stage).alias("stage"), F.array_join(letters, ",").alias("letters"), F.size(d).alias("documents"), error.alias("error"),
        )

    return let(documents, of)


def letter(subject: Column, body: Column, sent: Column, contract: str = "[A-Z]{4}") -> Column:
    """kind, transmittal, date, title, mark, revision, stage, letters (documents by code), documents, error.

    ``review codes``: a notification, by its subject or body. ``cover``: a letter that sends documents, by its subject, or by
    its body if that lists any; never a reply. ``other``: anything else; only kind and error are set. The revision is that of
    the first OD document, else of the first one; the stage is the OD document's code, else the commonest; letters without
    documents, of several kits, or of a mark that is no kit have an error and no stage. Dates are those that a notification
    names, else ``sent`` (a date)."""
    text = lambda c: G.dashes(F.coalesce(c, F.lit("")))

    def of(s: Column, b: Column) -> Column:
        first = lambda c: F.regexp_extract(c, TRANSMITTAL, 0)
        any_trm = F.coalesce(F.nullif(first(s), F.lit("")), first(b))
        noted = F.trim(F.regexp_extract(s, NOTIFICATION, 1))
        named = F.try_to_date(F.nullif(F.regexp_extract(F.regexp_replace(b, r"\s+", " "), DATED, 1), F.lit("")), "d.M.yyyy")
        notification = _letter("review codes", _documents(b, REVIEWED, contract, True), F.coalesce(F.nullif(noted, F.lit("")), any_trm), F.coalesce(named, sent))
        cover = lambda d: _letter("cover", d, any_trm, sent)
        sends = lambda d: ~s.rlike(REPLY) & (s.rlike(COVER) | (b.rlike(COVER_BODY) & (F.size(d) > 0)))
        rest = F.struct(F.lit("other").alias("kind"), *[F.lit(None).cast(k).alias(n) for n, k in (("transmittal", "string"), ("date", "date"), ("title", "string"), ("mark", "string"), ("revision", "string"), ("stage", "string"), ("letters", "string"), ("documents", "int"))], F.lit("not a letter of these kinds").alias("error"))
        return F.when((noted != "") | F.lower(b).contains(NOTIFIED), notification).otherwise(let(_first_of_each(_documents(b, SENT, contract, False)), lambda d: F.when(sends(d), cover(d)).otherwise(rest)))

    return let(F.trim(text(subject)), lambda s: let(F.replace(text(body), F.lit("\r\n"), F.lit("\n")), lambda b: of(s, b)))
