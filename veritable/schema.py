"""Column classes: every column is a ``number``, a ``date`` or a ``text``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "__rowid"

NUMBER, DATE, TEXT = "number", "date", "text"

# Texts from this length on are compared by digest.
DIGEST_BYTES = 64

# Name parts that mark a column as an identifier.
IDENTIFIER_TOKENS = {"id", "uuid", "key", "index"}


@dataclass(frozen=True)
class ColumnInfo:
    """Name, class and Spark type of one column."""

    name: str
    kind: str
    dtype: T.DataType

    @property
    def sql_type(self) -> str:
        return self.dtype.simpleString()

    @property
    def is_integer(self) -> bool:
        return isinstance(self.dtype, T.IntegralType)

    @property
    def ref(self) -> Column:
        return ref(self.name)

    @property
    def is_float(self) -> bool:
        return isinstance(self.dtype, (T.DoubleType, T.FloatType))

    @property
    def measured(self) -> Column:
        """The column as a double that can be measured with: NaN, which has no size, is NULL."""
        value = self.ref.cast("double")
        return F.when(~F.isnan(value), value) if self.is_float else value

    @property
    def label(self) -> Column:
        """The column as text, the form in which values are grouped and shown."""
        return self.ref if isinstance(self.dtype, T.StringType) else self.ref.cast("string")

    @property
    def blank(self) -> Column:
        """NULL, and for text columns also the empty string."""
        if self.kind == TEXT:
            return self.ref.isNull() | (self.label == "")
        return self.ref.isNull()

    @property
    def distinct_key(self) -> Column:
        """What stands for the value where only equality counts.

        Long texts are replaced by their SHA-256 digest, so that comparing rows does not
        shuffle whole documents. Digests have 64 characters, texts kept as they are fewer.
        """
        if not isinstance(self.dtype, T.StringType):
            return self.group_key
        return F.when(F.octet_length(self.ref) < DIGEST_BYTES, self.ref).otherwise(F.sha2(self.ref, 256))

    @property
    def group_key(self) -> Column:
        """The column in a form that Spark can group by (maps cannot be grouped)."""
        groupable = not isinstance(self.dtype, (T.MapType, T.VariantType))
        return self.ref if groupable else self.ref.cast("string")


def ref(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMBER
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return TEXT


def describe(schema: T.StructType) -> tuple[ColumnInfo, ...]:
    return tuple(
        ColumnInfo(f.name, kind_of(f.dataType), f.dataType) for f in schema if f.name != ROW_ID
    )


def named_like_identifier(name: str) -> bool:
    """Whether one of the words of a column name says identifier."""
    return any(word in IDENTIFIER_TOKENS for word in re.findall(r"[a-z0-9]+", name.lower()))
