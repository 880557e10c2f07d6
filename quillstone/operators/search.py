"""Counting, paging, faceting and hydrating a table under a filter specification."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators.filters import Catalog, Field, FilterSpec, UnsupportedPredicate, compile_spec

FACET_LIMIT, PAGE_LIMIT = 50, 50
API_LIMIT, API_DEFAULT = 100, 25


@dataclass
class Page:
    rows: DataFrame
    total: int
    cursor: str | None


def api_limit(limit: int | None) -> int:
    """A caller's page size, checked."""
    if limit is None:
        return API_DEFAULT
    if not 1 <= limit <= API_LIMIT:
        raise ValueError(f"limit must be from 1 to {API_LIMIT}")
    return limit


def order_by(df: DataFrame, sort: tuple[str, str] | None, id_col: str) -> list[Column]:
    """Nulls first ascending, last descending; ties by id."""
    if sort is None:
        return [F.col(id_col).asc()]
    name, way = sort
    if name not in df.columns:
        raise UnsupportedPredicate(f"can't sort by {name}")
    first = F.col(f"`{name}`").asc_nulls_first() if way == "asc" else F.col(f"`{name}`").desc_nulls_last()
    return [first, F.col(id_col).asc()]


class Table:
    """One adapter over any DataFrame: fields, count, page, facets and rows by id."""

    capabilities = {"text": True, "geo": True, "semantic": False, "facets": True}

    def __init__(self, df: DataFrame, fields: Catalog, id_col: str, text: str = "contains"):
        self.df, self.fields, self.id_col, self.text = df, fields, id_col, text

    def with_cells(self, cells: DataFrame, column_id: str, field: Field) -> Table:
        """This table with a computed column as a further field, to filter, facet and sort by. cells:
        (column_id, row_id, value), a row's current cell once; rows without a cell have null."""
        own = cells.where(F.col("column_id") == column_id).select(F.col("row_id").alias("__row"), F.regexp_replace("value", '^"|"$', "").try_cast(field.spark_type).alias(field.name))
        df = self.df.join(own, F.col(self.id_col).cast("string") == F.col("__row"), "left").drop("__row")
        return Table(df, {**self.fields, field.name: field}, self.id_col, self.text)

    def matching(self, spec: FilterSpec) -> DataFrame:
        return self.df.where(compile_spec(spec, self.fields, self.text))

    def count(self, spec: FilterSpec) -> DataFrame:
        return self.matching(spec).agg(F.count("*").alias("n"))

    def page(self, spec: FilterSpec, limit: int = PAGE_LIMIT, offset: int = 0) -> DataFrame:
        """One page, each row with its place rn (from 1) in the whole order."""
        rows = self.matching(spec).orderBy(*order_by(self.df, spec.sort, self.id_col)).offset(offset).limit(limit)
        return rows.withColumn("rn", F.row_number().over(Window.orderBy(*order_by(self.df, spec.sort, self.id_col))) + offset)

    def search(self, spec: FilterSpec, limit: int = PAGE_LIMIT, cursor: str | None = None) -> Page:
        """A page with the exact total and the cursor of the next, from one snapshot of the table."""
        offset = int(cursor or 0)
        total = self.matching(spec).count()
        last = offset + min(limit, max(0, total - offset))
        return Page(self.page(spec, limit, offset), total, str(last) if last < total else None)

    def facets(self, spec: FilterSpec, names: Sequence[str], limit: int = FACET_LIMIT) -> DataFrame:
        """(field, value, n): the values most rows have, of several fields from one scan.

        Rows are counted, not elements: an array that repeats a value counts once. Null and empty
        count nowhere. Ties go by value.
        """
        pairs = []
        for name in names:
            c = F.col(f"`{name}`")
            values = F.array_distinct(F.coalesce(c, F.array())) if self.fields[name].multi else F.array(c)
            pairs.append(F.transform(values, _named(name)))
        each = self.matching(spec).select(F.explode(F.concat(*pairs)).alias("p")).select("p.*").where("value is not null")
        counts = each.groupBy("field", "value").agg(F.count("*").alias("n"))
        best = Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("value").asc())
        return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)

    def facet(self, spec: FilterSpec, name: str, limit: int = FACET_LIMIT) -> DataFrame:
        c = F.col(f"`{name}`")
        rows = self.matching(spec)
        rows = rows.select(F.explode(F.array_distinct(F.coalesce(c, F.array()))).alias("value")) if self.fields[name].multi else rows.select(c.alias("value"))
        counts = rows.where("value is not null").groupBy(F.col("value").cast("string").alias("value")).agg(F.count("*").alias("n"))
        return counts.orderBy(F.col("n").desc(), "value").limit(limit)

    def vocabulary(self, limit: int = 40) -> DataFrame:
        """(field, terms) of every keyword field over the whole table, as text for a catalog."""
        names = [f.name for f in self.fields.values() if f.type == "keyword"]
        best = self.facets(FilterSpec(), names, limit)
        return best.groupBy("field").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x.value), " | ").alias("terms"))

    def hydrate(self, ids: DataFrame, position: str = "position") -> DataFrame:
        """Rows of the wanted ids, with each one's position; ids that don't exist are left out."""
        return ids.join(self.df, self.id_col)


def _named(name: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(name).alias("field"), v.cast("string").alias("value"))


def wanted(spark, ids: Sequence, id_col: str, kind: str = "long") -> DataFrame:
    """A table of ids with their positions; none for an empty list."""
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids, 1)], f"{id_col} {kind}, position int")


def hybrid(page: DataFrame, truth: DataFrame, id_col: str) -> DataFrame:
    """A page found in one store with the rows of another: order from the first, values from the second
    where it has the row, else those of the first."""
    names = [c for c in page.columns if c not in (id_col, "rn")]
    other = truth.select(F.col(id_col).alias("__id"), F.struct(*[c for c in names if c in truth.columns]).alias("__row"))
    out = page.join(other, F.col(id_col) == F.col("__id"), "left")
    cols = [F.when(F.col("__id").isNotNull(), F.col(f"__row.{c}")).otherwise(F.col(c)).alias(c) if c in truth.columns else F.col(c) for c in names]
    return out.select(id_col, "rn", *cols)


def keyset_page(df: DataFrame, sort_col: str, id_col: str, cursor: tuple | None, limit: int = 20) -> DataFrame:
    """Rows after a cursor (sort value, id), both descending. One more row than limit tells that there
    is a next page; its place says `more`."""
    if cursor is not None:
        df = df.where((F.col(sort_col) < F.lit(cursor[0])) | ((F.col(sort_col) == F.lit(cursor[0])) & (F.col(id_col) < F.lit(cursor[1]))))
    order = [F.col(sort_col).desc(), F.col(id_col).desc()]
    rows = df.orderBy(*order).limit(limit + 1).withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    return rows.withColumn("more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("rn") <= limit)


def seeded_sample(df: DataFrame, seed: int, id_col: str, n: int) -> DataFrame:
    """n rows in an order that depends on seed and id alone."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)


def cell_view(values: Column) -> Column:
    """An array as shown in a grid: three values and how many more; a dash for none."""
    n = F.size(F.coalesce(values, F.array()))
    return F.when(n == 0, "—").otherwise(F.concat(F.array_join(F.slice(values, 1, 3), ", "), F.when(n > 3, F.concat(F.lit(" +"), (n - 3).cast("string"))).otherwise("")))
