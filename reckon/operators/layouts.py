"""Row types of the sheet layouts: words that mark a heading, then presence masks in order."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Layout:
    """``heads``: texts that make a row a heading, by column. ``rules``: (type, columns that must be filled, columns that must
    be empty), the first that fits."""

    rules: list[tuple[str, str, str]]
    heads: dict[str, tuple[str, ...]] = field(default_factory=dict)
    head: str = "head"
    otherwise: str = "other"


_SUPPLY = "tags numbers name type_mark code vendor units values mass"
_BILL = "numbers work_code work_name units values"
_DEMAND = "numbers title specification tags code name type_mark units values"
#: Heading words and filled or empty columns of each layout.
LAYOUTS = {
    "supply": Layout([("position", "name units values", ""), ("section", "numbers name", "tags type_mark code vendor units values mass"), ("cabinet", "numbers name type_mark", "code vendor units values"), ("system", "tags", "numbers name type_mark code vendor units values mass"), ("empty", "", _SUPPLY)], {"name": ("Наименование и техническая",), "type_mark": ("Тип, марка,",), "code": ("Код продукции",), "vendor": ("Поставщик",)}),
    "demand": Layout([("position", "code name units values", ""), ("empty", "", _DEMAND)], {"name": ("Наименование МТР",), "code": ("Код РД",), "values": ("Кол-во",)}, head="other"),
    "net": Layout([("position", "ds_name ds_number title specification code name values units", "")], {"name": ("Наименование МТР",), "code_1c": ("Код 1С СОУ",), "type_mark": ("Технические характеристики",), "units": ("Ед. изм",)}, head="other"),
    "vendor": Layout([("position", "code", "")], {"name": ("Наименование",), "annotation": ("Примечание",), "code": ("Код BCC",), "units": ("Ед. изм",)}, head="other", otherwise="empty"),
    "compared": Layout([("position", "title system vendor", "")], {"name": ("Наименование Позиций Товара по РД",), "code_1c": ("Код 1С СОУ",), "type_mark": ("Технические требования (ГОСТ/ ТУ и др.)",), "units": ("Ед. изм.",)}, head="other"),
    "quantities": Layout([("position", "work_code units values", ""), ("empty", "", _BILL), ("section", "work_name", "units values")], {"units": ("Единица измерения",), "values": ("Количество",), "work_code": ("Код работ",), "work_name": ("Наименование работ",), "numbers": ("п/п",)}),
    "constant": Layout([("position", "", "")]),
}


def row_type(layout: Layout) -> Column:
    """The type of a row; null cells are empty. Columns are picked by name."""
    filled = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    every = lambda tests: reduce(Column.__and__, tests, F.lit(True))
    head = [F.coalesce(F.contains(F.col(c), F.lit(w)), F.lit(False)) for c, words in layout.heads.items() for w in words]
    out = F.when(reduce(Column.__or__, head, F.lit(False)), F.lit(layout.head))
    for name, full, empty in layout.rules:
        out = out.when(every([filled(c) for c in full.split()] + [~filled(c) for c in empty.split()]), F.lit(name))
    return out.otherwise(F.lit(layout.otherwise))


def system_name(layout_type: Column) -> dict[str, Column]:
    """A system row's text stands in the tags; it is its name."""
    is_system = layout_type == "system"
    return {"name": F.when(is_system, F.col("tags")).otherwise(F.col("name")), "tags": F.when(is_system, "").otherwise(F.col("tags"))}
