"""What an uploaded payload is, and what is derived from names and ids alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters trimmed before the first one of a payload is looked at (Unicode White_Space).
SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Limits of supplier ids, and of archives that are unpacked on arrival.
MAX_SUPPLIER = 1_000_000
LARGE_BYTES, LARGE_ENTRIES = 102_400, 100


def payload_type(body: Column) -> Column:
    """zip, xml, too_small (under 4 bytes) or unsupported; null for a null body. body: STRING."""
    kind = F.when(F.octet_length(body) < 4, "too_small").when(body.startswith("PK"), "zip")
    return F.when(body.isNotNull(), kind.when(body.rlike(f"^[{SPACE}]*<"), "xml").otherwise("unsupported"))


def supplier_id(raw: Column) -> tuple[Column, Column]:
    """The supplier id of a text, and why there is none: missing, not_numeric or out_of_range."""
    number = F.trim(raw).try_cast("int")
    good = number.between(1, MAX_SUPPLIER)
    reason = F.when(raw.isNull() | (F.trim(raw) == ""), "missing").when(number.isNull(), "not_numeric").when(~good, "out_of_range")
    return F.when(good, number), reason


def validate_uploads(df: DataFrame, supplier: str, body: str, max_bytes: int | None = 16 << 20) -> DataFrame:
    """df with supplier_id, payload_type, n_bytes and reason (null if the upload is accepted). body: STRING or BINARY.

    Reasons in order: a supplier reason, empty, too_large, too_small, unsupported. A null body is empty. With
    max_bytes None nothing is too large. Columns of df named like the added ones are replaced.
    """
    number, why = supplier_id(F.col(supplier).cast("string"))
    size, kind = F.coalesce(F.octet_length(body), F.lit(0)), payload_type(F.col(body).cast("string"))
    reason = F.coalesce(why, F.when(size == 0, "empty").when(F.lit(False) if max_bytes is None else size > max_bytes, "too_large").when(kind.isin("too_small", "unsupported"), kind))
    return df.withColumns({"supplier_id": number, "n_bytes": size, "payload_type": F.when(kind.isin("zip", "xml"), kind), "reason": reason})


def archive_route(size: Column, entries: Column, max_bytes: int = LARGE_BYTES, max_entries: int = LARGE_ENTRIES) -> Column:
    """raw_large for an archive over either limit (both strict), else zip_with_members; an unknown number of entries counts as 0."""
    return F.when((size > max_bytes) | (F.coalesce(entries, F.lit(0)) > max_entries), "raw_large").otherwise("zip_with_members")


def content_type(role: Column, name: Column) -> Column:
    """The media type a file is served with."""
    low = F.lower(F.coalesce(name, F.lit("")))
    by_name = F.when(low.endswith(".xml"), "application/xml").when(low.endswith(".zip"), "application/zip").otherwise("application/octet-stream")
    return F.when(role == "unpack_error", "text/plain; charset=utf-8").otherwise(by_name)


def folder_supplier(name: Column) -> Column:
    """The supplier of a folder name: digits, or a-b for the first of a range; null for others."""
    return F.regexp_extract(name, r"^(\d+)(-\d+)?$", 1).try_cast("int")


def is_uuid(text: Column) -> Column:
    return F.trim(text).rlike("(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$")


def is_zstd(data: Column) -> Column:
    """Whether BINARY begins with the magic number of a zstd frame; false for shorter ones."""
    return F.coalesce(F.substring(data, 1, 4) == F.unhex(F.lit("28B52FFD")), F.lit(False))
