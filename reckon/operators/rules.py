"""Declarative document checks: each is a code and a predicate of one wide row, all judged in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.functions import grammar as G


def equal_all(*columns: Column) -> Column:
    """All values that are there are one and the same."""
    return F.size(F.array_distinct(F.array_compact(F.array(*columns)))) <= 1


def document_checks(contract: str = "[A-Z]{4}") -> dict[int, Column]:
    """Failure of each check, by its code. A null predicate is no failure."""
    c = F.col
    name = c("__name")  # of findings(): the file name with plain dashes, worked out once
    drawn, checked = F.try_to_date("date_drawn", "d.M.yyyy"), F.try_to_date("date_checked", "d.M.yyyy")
    return {
        1000: F.size(F.regexp_extract_all(name, F.lit(G.STRICT % contract), F.lit(0))) != 1,  # the name's grammar
        1001: c("doc_code").rlike("[А-Яа-яЁё]") | c("revision_stamp").rlike("[А-Яа-яЁё]"),  # forbidden script in codes
        1002: c("n_layers") > 0,
        1003: c("n_annotations") > 0,
        1004: c("format_declared") != c("format_real"),
        1005: ~equal_all(c("revision_stamp"), c("revision_title"), c("revision_name")),
        1006: c("register_revision") != c("revision_stamp"),
        1007: c("register_formats") != c("formats"),
        1008: c("pages_declared") != c("pages_real"),
        1009: ~equal_all(c("number_stamp"), c("number_title"), c("number_name")),
        1010: c("page_number") != c("sheet"),
        1011: c("register_title") != c("title"),
        1012: c("n_facilities") > 1,
        1013: (c("date_drawn").isNotNull() & drawn.isNull()) | (c("date_checked").isNotNull() & checked.isNull()) | (drawn > checked),
        1014: ~F.contains(c("body"), c("doc_code")),
        1015: F.size(F.filter(F.split("page_tokens", ","), lambda x: F.trim(x) != "")) != c("pages_real"),
        1016: ~F.endswith(F.lower(name), F.lit(".pdf")),
        1017: ~c("issue").isin("IFC", "IFR"),
        1018: c("mark_stamp") != c("mark_name"),
        1019: name.rlike(r"(?i)(\.[a-z]{3,4}).*\.[a-z]{3,5}$") & (F.lower(F.regexp_extract(name, r"(\.[A-Za-z]{3,4})_", 1)) == F.lower(F.regexp_extract(name, r"(\.[A-Za-z]{3,5})$", 1))),
    }


def findings(df: DataFrame, checks: dict[int, Column], keys: list[str], gate: int | None = None, enabled: set[int] | None = None) -> DataFrame:
    """(keys, rule): a row for each failed check that is enabled. If the gate fails, the others aren't judged."""
    df = df.withColumn("__name", G.dashes(F.col("file_name")))
    on = {k: F.coalesce(p, F.lit(False)) for k, p in checks.items() if enabled is None or k in enabled}
    stop = on.get(gate, F.lit(False))
    hits = F.when(stop, F.array(F.lit(gate))).otherwise(F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in on.items() if k != gate])))
    return df.select(*keys, F.explode(hits).alias("rule"))
