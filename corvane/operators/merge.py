"""State writers: an old table and a change give the new table.

Parquet has no UPDATE, so every writer is a function from (state, change) to the next state. Where a change holds a
key twice, the row that counts is named by an explicit order, never by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the given order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def insert_if_absent(state: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """M1: rows of new whose key the state lacks are added; of several with a key, the first. Stored rows win."""
    fresh = first_of(new, keys, order).join(state.select(*keys), keys, "left_anti")
    return state.unionByName(fresh)


def insert_or_get(state: DataFrame, new: DataFrame, keys: list[str], id_col: str, new_id: Column) -> DataFrame:
    """M5: every row of new with the stored id of its key, or the one made for it; new_id is made from the key columns, once a key."""
    held = state.select(*keys, F.col(id_col).alias("__id"))
    made = new.select(*keys).distinct().join(held, keys, "left").withColumn("__id", F.coalesce("__id", new_id))
    made = made.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__id").alias("__made"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return new.join(made, same, "left").withColumn(id_col, F.col("__made")).drop("__made", *(f"__{k}" for k in keys))


def _updated(state: DataFrame, new: DataFrame, keys: list[str], columns: list[str], usable, value, order: list[str]) -> DataFrame:
    """Rows of the state with the change of their key, one a key: of a column's usable values the first by the order and itself."""
    first = [F.min_by(F.col(c), F.when(usable(F.col(c)), F.struct(*order, c))).alias(f"__new_{c}") for c in columns]
    joined = state.join(new.groupBy(*keys).agg(*first), keys, "left")
    kept = [value(F.col(c), F.col(f"__new_{c}")).alias(c) if c in columns else F.col(c) for c in state.columns]
    return joined.select(*kept)


def fill_empty(state: DataFrame, new: DataFrame, keys: list[str], columns: list[str], guard: Column | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """An empty string is replaced by a new value that isn't empty; all else stays. guard limits the rows.

    Of several changes of a key, the first by the order that isn't empty counts, of equally early ones the least.
    """
    ok = F.lit(True) if guard is None else guard
    return _updated(state, new, keys, columns, lambda v: v != "", lambda old, v: F.when(ok & (old == "") & v.isNotNull(), v).otherwise(old), list(order))


def fill_empty_json(state: DataFrame, new: DataFrame, keys: list[str], column: str, order: tuple[str, ...] = ()) -> DataFrame:
    """M3: a JSON text that is null or {} is replaced by one that is neither; of several, as in fill_empty."""
    empty = lambda c: c.isNull() | (F.trim(c) == "{}")
    return _updated(state, new, keys, [column], lambda v: ~empty(v), lambda old, v: F.when(empty(old) & v.isNotNull(), v).otherwise(old), list(order))


def upsert(state: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """M4: the last write of a key wins, and any write wins over the state. order: the latest first."""
    last = first_of(new, keys, order)
    return state.join(last.select(*keys), keys, "left_anti").unionByName(last)


def upsert_merging(state: DataFrame, new: DataFrame, keys: list[str], order: list[Column], array: str) -> DataFrame:
    """M4 with the array column united: one row from several sources names them all.

    The state's values come first, then those of every row of the change, the latest row's first.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    ranked = new.withColumn("__rank", rank)
    spots = ranked.select(*keys, "__rank", F.posexplode(array).alias("__pos", "__value"))
    spots = spots.groupBy(*keys, "__value").agg(F.min(F.struct("__rank", "__pos")).alias("__at"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__value"))), lambda x: x["__value"])
    last = ranked.where("__rank = 1").drop("__rank", array).join(spots.groupBy(*keys).agg(named.alias("__new")), keys, "left")
    both = last.join(state.select(*keys, F.col(array).alias("__old")), keys, "left")
    none = F.array().cast(dict(state.dtypes)[array])
    merged = both.withColumn(array, F.array_union(F.coalesce("__old", none), F.coalesce("__new", none))).select(*state.columns)
    return state.join(last.select(*keys), keys, "left_anti").unionByName(merged)


def stamp(state: DataFrame, keys_seen: DataFrame, keys: list[str], column: str, value: Column) -> DataFrame:
    """M9: the column is set on the rows whose key is listed."""
    hit = keys_seen.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return state.join(hit, keys, "left").withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).drop("__hit")


def append_valid(log: DataFrame, new: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """M8: rows are appended whose value is one of the allowed; another value is an error."""
    checked = F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit(f"{column} has no value "), F.coalesce(column, F.lit("null"))))
    )
    return log.unionByName(new.withColumn(column, checked.cast("string")))


def json_object(text: Column) -> Column:
    """The top-level entries of a JSON object as a map of variants; null counts as {}."""
    return F.coalesce(F.from_json(text, "map<string, variant>"), F.from_json(F.lit("{}"), "map<string, variant>"))


def json_merge(old: Column, new: Column) -> Column:
    """Shallow merge, the right side wins; written with its keys sorted."""
    held = F.map_filter(json_object(old), lambda k, _: ~F.array_contains(F.map_keys(json_object(new)), k))
    return sorted_json(F.map_concat(held, json_object(new)))


def json_without(text: Column, *keys: str) -> Column:
    """The object without the keys."""
    return sorted_json(F.map_filter(json_object(text), lambda k, _: ~k.isin(*keys)))


def sorted_json(entries: Column) -> Column:
    order = F.array_sort(F.map_keys(entries))
    return F.concat(
        F.lit("{"),
        F.array_join(F.transform(order, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.coalesce(F.to_json(F.try_element_at(entries, k)), F.lit("null")))), ","),
        F.lit("}"),
    )


def append_missing(array: Column, value: Column) -> Column:
    """The value is appended if it isn't null and not there yet."""
    return F.when(value.isNull() | F.coalesce(F.array_contains(array, value), F.lit(False)), array).otherwise(F.array_append(array, value))


def without(state: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true go; unknown stays, as with DELETE."""
    return state.where(~F.coalesce(condition, F.lit(False)))


def remap(column: Column, values: dict[str, str]) -> Column:
    """Listed values become others, the rest stays."""
    mapped = F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), column)
    return F.coalesce(mapped, column)


def latest_by(log: DataFrame, parent: str, value: str, order: str) -> DataFrame:
    """Each parent's value of the row inserted last, by insertion number and not by date."""
    return log.groupBy(parent).agg(F.max_by(value, order).alias(value))
