"""Products: the table of files behind datasets, links to them, retrieval plans, changed-records listings."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import timestamp_literal
from ..operators import keys, limits, predicates
from ..operators.skew import salted_join

PRODUCT_COLUMNS = ("accref", "access_path", "source_table", "mime", "preview", "preview_mime", "datalink", "owner",
                   "embargo", "accsize")


def product_rows(df: DataFrame, accref, path, mime, size, source_table: str, owner=None, embargo=None, preview=None,
                 preview_mime=None, datalink=None) -> DataFrame:
    """Rows of the products table from expressions over a table."""
    def made(value, kind):
        if value is None:
            return F.lit(None).cast(kind)
        return (F.expr(value) if isinstance(value, str) else value).cast(kind)

    return df.select(
        made(accref, "string").alias("accref"), made(path, "string").alias("access_path"),
        F.lit(source_table).alias("source_table"), made(mime, "string").alias("mime"),
        made(preview, "string").alias("preview"), made(preview_mime, "string").alias("preview_mime"),
        made(datalink, "string").alias("datalink"), made(owner, "string").alias("owner"),
        made(embargo, "date").alias("embargo"), made(size, "bigint").alias("accsize"))


def merge_products(stored: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The products table after feeding rows; the last row of an accref wins."""
    return keys.merge(stored, new, ["accref"], order, "overwrite")


def retrieval_plan(wanted: DataFrame, products: DataFrame, groups=(), today: datetime.date | None = None,
                   accref: str = "accref") -> DataFrame:
    """What to do about each wanted accref: ``ok`` with its path, ``forbidden`` or ``missing``.

    Each accref is looked up once; one asked for very often does not skew the join.
    """
    unique = wanted.select(F.col(accref).alias("accref")).distinct()
    visible = predicates.visible_to("embargo", "owner", groups, today)
    known = products.select("accref", "access_path", "mime", "accsize", F.coalesce(visible, F.lit(False)).alias("__ok"))
    plan = unique.join(known, "accref", "left")
    status = F.when(F.col("__ok").isNull(), "missing").when(F.col("__ok"), "ok").otherwise("forbidden")
    plan = plan.withColumn("status", status)
    return plan.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in ("access_path", "mime", "accsize")}).drop(
        "__ok")


def _link(semantics: str, url: Column, description: str, content_type: Column | None = None,
          content_length: Column | None = None, service: str | None = None, when: Column | None = None) -> Column:
    null = F.lit(None)
    row = F.struct(
        url.cast("string").alias("access_url"), F.lit(service).cast("string").alias("service_def"),
        null.cast("string").alias("error_message"), F.lit(description).alias("description"),
        F.lit(semantics).alias("semantics"), (content_type if content_type is not None else null).cast("string").alias(
            "content_type"),
        (content_length if content_length is not None else null).cast("bigint").alias("content_length"))
    return row if when is None else F.when(when, row)


LINK_COLUMNS = ("ID", "access_url", "service_def", "error_message", "description", "semantics", "content_type",
                "content_length")


def links(ids: DataFrame, products: DataFrame, base_url: str = "http://localhost", services: dict | None = None,
          extra: DataFrame | None = None, id_column: str = "ID") -> DataFrame:
    """The links table of dataset ids.

    Known ids give the dataset (#this), a #preview where there is one, and a
    #proc row per service (name -> path); unknown ids give a row with an
    error message.  ``extra`` has further rows with the columns of the table.
    """
    asked = ids.select(F.col(id_column).alias("ID")).distinct()
    known = products.select("accref", "mime", "preview", "preview_mime", "accsize", F.lit(True).alias("__known"))
    joined = asked.join(known, F.col("ID") == F.col("accref"), "left")
    encoded = F.url_encode("accref")
    product_url = F.concat(F.lit(f"{base_url}/getproduct/"), encoded)
    is_url = F.col("preview").startswith("http")
    preview_url = F.when(is_url, F.col("preview")).otherwise(F.concat(product_url, F.lit("?preview=True")))
    is_known = F.col("__known").isNotNull()
    rows = [
        _link("#this", product_url, "The full dataset.", F.col("mime"), F.col("accsize"), when=is_known),
        _link("#preview", preview_url, "A preview for the dataset.", F.col("preview_mime"),
              when=is_known & F.col("preview").isNotNull()),
    ]
    for name, path in (services or {}).items():
        rows.append(_link("#proc", F.lit(f"{base_url}/{path}"), "Processing service", service=name, when=is_known))
    null = F.lit(None)
    fault = F.when(~is_known, F.struct(
        null.cast("string").alias("access_url"), null.cast("string").alias("service_def"),
        F.concat(F.lit("NotFoundFault: no dataset "), F.col("ID")).alias("error_message"),
        null.cast("string").alias("description"), F.lit("#this").alias("semantics"),
        null.cast("string").alias("content_type"), null.cast("bigint").alias("content_length")))
    made = joined.select("ID", F.explode(F.filter(F.array(*rows, fault), lambda r: r.isNotNull())).alias("r")).select(
        "ID", "r.*")
    if extra is not None:
        made = made.unionByName(extra.join(asked, "ID", "left_semi").select(*LINK_COLUMNS))
    return made


def _moment(text: str, upper: bool) -> tuple[datetime.datetime, bool, str]:
    """(limit, exclusive, granularity); bare days as upper limits include the day."""
    if "T" in text:
        return datetime.datetime.fromisoformat(text.rstrip("Z")), False, "datetime"
    day = datetime.datetime.fromisoformat(text)
    return (day + datetime.timedelta(days=1), True, "date") if upper else (day, False, "date")


def changed_records(records: DataFrame, stamp: str, from_: str | None = None, until: str | None = None,
                    sets: DataFrame | None = None, set_name: str | None = None, key=("res_id",)) -> DataFrame:
    """Records changed in a period and belonging to a set.

    Both limits need the same granularity; a bare day as ``until`` counts as
    a whole.
    """
    tests, grains = [], set()
    if from_:
        limit, _, grain = _moment(from_, False)
        grains.add(grain)
        tests.append(F.col(stamp) >= timestamp_literal(limit))
    if until:
        limit, exclusive, grain = _moment(until, True)
        grains.add(grain)
        limit = timestamp_literal(limit)
        tests.append(F.col(stamp) < limit if exclusive else F.col(stamp) <= limit)
    if len(grains) > 1:
        raise ValueError("from and until need the same granularity")
    found = records.filter(predicates.conjunction(tests))
    if sets is not None and set_name is not None:
        found = found.join(sets.filter(F.col("set_name") == set_name), list(key), "left_semi")
    return found


def listing_page(records: DataFrame, key: str, size: int, after=None) -> DataFrame:
    """A page of a listing, continued after a key value."""
    return limits.page_after(records, key, size, after)


def with_products(df: DataFrame, products: DataFrame, accref: str = "accref") -> DataFrame:
    """Rows with the columns of their product; products many rows refer to are split."""
    return salted_join(df, products.withColumnRenamed("accref", accref), [accref], "left")
