"""Naming rules: column names, feature names and view names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Fixed values of the data model.
PERSON = "eid"
BASELINE_MARK = "-0."
CATEGORICAL_TYPES = ("Categorical (multiple)", "Categorical (single)")
EXCLUDED_CODES = ("99999",)
DEATH_FIELD = "40000"
ROOT_PARENT = "0"


def base_field(name: str | Column) -> Column:
    """Field part of a column or feature name: ``20001-0.3`` and ``20001=1059`` give ``20001``."""
    column = F.col(name) if isinstance(name, str) else name
    return F.substring_index(F.substring_index(column, "=", 1), "-", 1)


def base_field_of(column_name: str) -> str:
    """The same rule for a column name known on the driver."""
    return column_name.split("-", 1)[0]


def code_part(name: str | Column) -> Column:
    """Code behind the first ``=``; null for a numeric feature."""
    column = F.col(name) if isinstance(name, str) else name
    return F.when(column.contains("="), F.split(column, "=", 2)[1])


def coded_name(field: Column, code: Column) -> Column:
    return F.concat_ws("=", field, code)


def quoted(column_name: str) -> Column:
    """Reference to a column whose name holds dots."""
    return F.col("`" + column_name.replace("`", "``") + "`")


def view_name_of(path: str) -> str:
    """Last word of the path, without a ``.csv`` ending; the path itself if there is none."""
    found = re.search(r"(\w+)(\.csv)?$", path)
    return found.group(1) if found else path


def is_categorical(type_column: str | Column) -> Column:
    column = F.col(type_column) if isinstance(type_column, str) else type_column
    return column.isin(*CATEGORICAL_TYPES)
