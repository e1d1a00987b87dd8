"""Journals that letters edit, against a plain walk over the lines."""

import random
import re
import time
from datetime import date, datetime

from pyspark.sql import functions as F

from reckon.operators import journal as J
from reckon.plans import journal as plans

STAGES = (("код А", "code_a"), ("код B", "code_b"), ("код C", "code_c"), ("прошла вх контр", "incoming_passed"), ("на загрузку в СР", "sr_upload"), ("отпр на ТДО", "tdo_sent"))
WORDS = {"code_a": "код А на", "code_b": "код B на", "code_c": "код C на", "incoming_passed": "прошла вх контр", "sr_upload": "отпр. на загрузку в СР", "tdo_sent": "отпр на ТДО"}
STATUS = {"code_a": "РД Согласовано", "code_b": "РД_Корректировка по зам.", "code_c": "РД_Корректировка по зам.", "incoming_passed": "Прошла входной контроль", "sr_upload": "Отпр. на входной контроль", "tdo_sent": "Отпр. на входной контроль"}


def day_of(text):
    try:
        return datetime.strptime(text or "", "%d.%m.%Y")
    except ValueError:
        return None


def read(text):
    """(date, stage, revision, transmittals, rest) of the line forms used here."""
    found = re.match(r"(\d{1,2}\.\d{1,2}\.\d{4})\s*(.*)$", text.strip())
    when, rest = found.groups() if found else (None, text.strip())
    rest = re.sub(r"(?:^|\s+)(?:MTO (?:Нет|\d+)(?: auto)?|auto)\s*$", "", rest)
    stage = next((k for w, k in STAGES if w in rest), "other")
    number = re.search(r"рев\. ?(\d+|V)", rest)
    revision = "" if not number else number[1] if number[1] == "V" else "0" if not int(number[1]) else number[1].zfill(2)
    return when, stage, revision, tuple(dict.fromkeys(x.lower() for x in re.findall(r"N-TRM-\d+", rest))), rest


def put(lines, new):
    """(lines, action) after a letter's line."""
    n = read(new)
    for i, x in enumerate(lines):
        if x.strip() == new or (read(x)[1] != "other" and read(x)[:4] == n[:4]):
            return (lines, "unchanged") if x.strip() == new else (lines[:i] + [new] + lines[i + 1 :], "replaced")
    for i, x in enumerate(lines):
        o = read(x)
        bare = re.sub(r"[\s.,;:()\-]+", "", re.sub(r"N-TRM-\d+", "", o[4])) == "" and (o[3] or not o[4])
        stub = o[1] == "other" and day_of(o[0]) and day_of(o[0]) == day_of(n[0]) and o[2] in ("", n[2]) and set(o[3]) <= set(n[3]) and bare
        if o[:2] == n[:2] or stub:
            return lines[:i] + [new] + lines[i + 1 :], "replaced"
    at = next((i for i, x in enumerate(lines) if day_of(read(x)[0]) and day_of(read(x)[0]) > day_of(n[0])), len(lines))
    return lines[:at] + [new] + lines[at:], "inserted"


def number(cell):
    found = re.search(r"(\d+|[VS])", cell or "")
    return found and (int(found[1]) if found[1].isdigit() else found[1])


def plain(cells, lines, letters):
    """Letters and journals by kit. ``letters``: id, kit, date, stage, revision, transmittal, file revision, absent."""
    out, journals, state = [], {}, {}
    for kit, revision, status in cells:
        state[kit] = max(state.get(kit, ("", "")), (revision or "", status or ""))
    for kit, _, text in sorted(lines, key=lambda x: x[1]):
        if text and text.strip():
            journals.setdefault(kit, []).append(text)
    for i, kit, when, stage, revision, token, file, absent in letters:
        if when is None or stage not in WORDS:
            out.append((i, None, False, False, False, None, None, J.NO_LINE))
            continue
        shown = "" if revision is None else revision if not revision.isdigit() else "0" if not int(revision) else revision.zfill(2)
        new = " ".join(x for x in (f"{when:%d.%m.%Y}", WORDS[stage] if shown else WORDS[stage].removesuffix(" на"), f"рев. {shown}" if shown else "", token or "", f"MTO {file}" if file else "MTO Нет" if absent else "", "auto") if x)
        if kit not in state or kit is None:
            out.append((i, None, False, False, False, None, None, J.NO_KIT))
            continue
        journals[kit], action = put(journals.get(kit, []), new)
        last = [x for x in map(read, journals[kit]) if x[0]][-1]
        newest, (d, e) = last[:2] == read(new)[:2], state[kit]
        cell = f"Рев. {shown}" if shown else ""
        write_d = bool(newest and cell and (number(d) != number(cell) if number(d) is not None else d.strip() != cell))
        write_e = newest and e.strip().lower() != STATUS[stage].lower()
        if newest:
            state[kit] = (cell or d, STATUS[stage])
        out.append((i, action, action != "unchanged", write_d, write_e, *state[kit], ""))
    return out, {(k, i): x for k, v in journals.items() for i, x in enumerate(v)}


def check(df, cells, lines, letters):
    rows = df.collect()
    got = sorted((r.letter_id, r.action, r.write_line, r.write_revision, r.write_status, r.revision, r.status, r.error) for r in rows if r.kind == "letter")
    expected, journals = plain(cells, lines, letters)
    assert got == sorted(expected)
    assert {(r.kit, r.position): r.line for r in rows if r.kind == "line"} == journals
    return {(g[1], g[7]) for g in got}, {g[2:5] for g in got}


CELLS, LINES, LETTERS = "kit string, revision string, status string", "kit string, position int, line string", "letter_id int, kit string, date date, stage string, revision string, transmittal string, file_revision string, file_absent boolean"


def test_random_journals(spark):
    rng = random.Random(11)
    days = [date(2024, 1, k) for k in range(1, 8)]
    short = lambda x: f"{x.day}.{x.month}.{x.year}" if rng.random() < 0.4 else f"{x:%d.%m.%Y}"
    tail = lambda: rng.choice(["", " N-TRM-1", " N-TRM-2", " N-TRM-1 N-TRM-2", " n-trm-1".upper()])
    line = lambda: rng.choice([
        short(rng.choice(days)) + rng.choice(["", tail(), tail() + " .", " звонок", " рев. 1" + tail()]),
        f"{short(rng.choice(days))} {rng.choice(list(WORDS.values())).removesuffix(' на')}{rng.choice(['', ' рев. 01', ' рев. 2', ' рев. V'])}{tail()}{rng.choice(['', ' auto', ' MTO 03 auto', ' MTO Нет'])}", rng.choice(["без даты", "", "  ", "32.13.2024 звонок"]),
    ])
    kits = [f"k{i}" for i in range(60)]
    cells = [(k, rng.choice(["Рев. 1", "рев 01", "Рев. V", "", "x", None]), rng.choice(["рд согласовано", "", None, "Отпр. на входной контроль"])) for k in kits[:50]] + [("k0", "Рев. 3", "")]
    lines = [(rng.choice(kits), i, line()) for i in range(400)]
    letters = [(i, rng.choice(kits + ["nobody"]), rng.choice([*days, None]), rng.choice([*WORDS, "other", "tdo_passed"]), rng.choice(["1", "01", "02", "V", None]), rng.choice(["N-TRM-1", "N-TRM-2", None]), rng.choice([None, None, "03"]), rng.random() < 0.2) for i in range(900)]
    df = J.written(spark.createDataFrame(cells, CELLS), spark.createDataFrame(lines, LINES), spark.createDataFrame(letters, LETTERS).withColumn("position", F.col("letter_id")), ["kit"])
    kinds, writes = check(df, cells, lines, letters)
    assert kinds == {("inserted", ""), ("replaced", ""), ("unchanged", ""), (None, J.NO_LINE), (None, J.NO_KIT)} and len(writes) == 5


def test_null_kits_and_empty_tables(spark):
    none = lambda s: spark.createDataFrame([], s)
    letters = spark.createDataFrame([(1, None, date(2024, 1, 1), "code_a", "1", None, None, None), (2, "a", None, None, None, None, None, None)], LETTERS).withColumn("position", F.lit(0))
    lines = spark.createDataFrame([(None, 4, "x"), ("b", 1, "y"), ("b", 0, "z")], LINES)
    rows = J.written(none(CELLS), lines, letters, ["kit"]).collect()
    assert sorted((r.letter_id, r.error) for r in rows if r.kind == "letter") == [(1, J.NO_KIT), (2, J.NO_LINE)]
    assert sorted((str(r.kit), r.position, r.line) for r in rows if r.kind == "line") == [("None", 4, "x"), ("b", 0, "z"), ("b", 1, "y")]
    assert J.written(none(CELLS), none(LINES), none(LETTERS).withColumn("position", F.lit(0)), ["kit"]).count() == 0


def test_a_hot_kit_takes_seconds(spark):
    """30,000 lines and as many letters of one kit."""
    n = 30_000
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.xxhash64("id") % 9000).cast("int"))
    lines = spark.range(n).select(F.lit("a").alias("kit"), F.col("id").cast("int").alias("position"), F.concat(F.date_format(day, "dd.MM.yyyy"), F.when(F.col("id") % 3 == 0, "").otherwise(" отпр на ТДО")).alias("line"))
    letters = spark.range(n).select(F.col("id").cast("int").alias("letter_id"), F.col("id").alias("position"), F.lit("a").alias("kit"), F.date_add(day, 5).alias("date"), F.lit("code_a").alias("stage"), (F.col("id") % 3).cast("string").alias("revision"), F.lit(None).cast("string").alias("transmittal"))
    begin = time.time()
    rows = J.written(spark.createDataFrame([("a", "", "")], CELLS), lines, letters, ["kit"]).groupBy("kind").count().collect()
    assert time.time() - begin < 40
    found = {r.kind: r["count"] for r in rows}
    assert found["letter"] == n and found["line"] > n


def test_query_against_the_plain_walk(spark):
    d = "/root/testdata/sf0.01"
    cells, lines, sent = plans.sides(spark, d)
    letters = [(r.letter_id, r.kit, r.date, r.stage, r.revision, r.transmittal, r.file_revision, r.file_absent) for r in sent.orderBy("position").collect()]
    kinds, writes = check(plans.journal_writes(spark, d), [tuple(r) for r in cells.collect()], [(r.kit, r.position, r.line) for r in lines.collect()], letters)
    assert kinds == {("inserted", ""), ("replaced", ""), (None, J.NO_LINE), (None, J.NO_KIT)} | ({("unchanged", "")} & kinds) and len(writes) > 4
