"""Entity schemas of the store, and the expressions of its actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.numbering import numbered
from ..plans.names import free_names
from ..plans.scratch import scratch_path, stored

ITEM = "id int, image string, largeimage string, description string, price int, score double, category string, salednumber int, discountPercent int, sellerName string, quantity int, priceAfterDiscount int, hasdiscount int, introduction string"
USER = "userid int, image string, username string, email string, favorites array<int>, shoppingcart map<int,int>, is_subscriber int, Subscriptionend string"
RECEIPT = "id int, items array<int>, timeofshopping timestamp_ntz, totalprice int, orderStatus string"
VIEWPOINT = "review_text string, review_id int, likes int, dislikes int, username string"
#: Actions of requests and the fields that each reads.
ACTIONS = {"getallitems": ("i",), "checkuser": ("username", "password"), "returnuserbyid": ("userid",), "getviews": ("id",), "addview": ("id", "review_text", "userid"), "addtoshoppingcart": ("id", "userid"), "decreasefromshoppingcart": ("id", "userid")}
#: Positions to a step of an index.
STEP = 100_000
STATUSES = ("Pending", "confirmed", "Delivered")


def discounted(price: Column, percent: Column) -> Column:
    """price less percent, truncated toward zero."""
    hundredths = price.cast("bigint") * (100 - percent)
    return F.floor(hundredths.cast("decimal(20,0)") / 100).cast("bigint") + F.when((hundredths < 0) & (hundredths % 100 != 0), 1).otherwise(0)  # decimals are exact


@dataclass(frozen=True)
class Positions:
    """Rows in the order of columns, stored by ranges, and where each range begins."""

    rows: DataFrame
    starts: DataFrame
    total: int

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """(i, json) for the positions from 0 in the column `i` of a table; none beyond the end. Only ranges with an asked position are read."""
        inside = wanted.select(F.col("i").cast("long").alias("i")).filter(F.col("i").between(0, self.total - 1)).distinct()
        # ranges and positions meet in steps of the positions, so the join has a key
        ranges = self.starts.select("*", F.explode(F.sequence(F.floor(F.col("start") / STEP), F.floor((F.col("end") - 1) / STEP))).alias("step"))
        placed = inside.withColumn("step", F.floor(F.col("i") / STEP)).join(ranges, "step").filter((F.col("i") >= F.col("start")) & (F.col("i") < F.col("end")))
        placed = placed.select("i", "range", (F.col("i") - F.col("start")).alias("at"))
        # the ranges' folders are pruned by those that are asked for
        return self.rows.join(placed, ["range", "at"]).select("i", "json")


def position_index(items: DataFrame, *order: str) -> Positions:
    """The rows of items as JSON, in ranges of the order, ties in any; one count a range reaches the driver."""
    spark, path = items.sparkSession, scratch_path(items.sparkSession, "positions")
    json, place = free_names(items, "json", "place")
    ranged = items.withColumn(json, F.to_json(F.struct(*[items[c] for c in items.columns]))).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select(F.col(json).alias("json"), F.monotonically_increasing_id().alias(place))
    split = ranged.select("json", F.shiftrightunsigned(place, 33).cast("int").alias("range"), F.col(place).bitwiseAND((1 << 33) - 1).alias("at"))
    split.write.partitionBy("range").parquet(path)
    rows = spark.read.schema("json string, at long, range int").parquet(path)
    starts, total = [], 0
    for r in sorted(rows.groupBy("range").count().collect()):
        starts.append((r[0], total, total + r[1]))
        total += r[1]
    return Positions(rows, spark.createDataFrame(starts, "range int, start long, end long"), total)


def item_by_index(items: DataFrame, order: str, index: int) -> DataFrame:
    """The item at a position from 0 in the order of a column, as JSON; no row beyond the end."""
    return position_index(items, order).fetch(items.sparkSession.range(index, index + 1).select(F.col("id").alias("i")))


def row_by_key(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return rows.filter(F.col(key) == F.lit(value))


def views_of(views: DataFrame, items: DataFrame, item_id: int) -> DataFrame:
    """Rows of views that belong to an item that exists."""
    return row_by_key(views, "id", item_id).join(row_by_key(items, "id", item_id), "id", "left_semi")


def exists(rows: DataFrame, **values: object) -> DataFrame:
    """One row: does any row have all these values?"""
    for key, value in values.items():
        rows = row_by_key(rows, key, value)
    return rows.limit(1).agg((F.count("*") > 0).alias("found"))


def request_fields(request: Column) -> list[Column]:
    """Action and known fields of a JSON request; missing ones are empty, an unknown action is `Invalid action`."""
    field = lambda k: F.coalesce(F.get_json_object(request, f"$.{k}"), F.lit(""))
    action = field("action")
    names = sorted({f for fields in ACTIONS.values() for f in fields} - {"password"})
    return [F.when(action.isin(*ACTIONS), action).otherwise("Invalid action").alias("action"), *[field(n).alias(n) for n in names]]


def cart_added(cart: Column, item: Column) -> Column:
    """The cart with one more of an item."""
    count = F.coalesce(F.try_element_at(cart, item), F.lit(0)) + 1
    return F.map_concat(F.map_filter(cart, lambda k, _: k != item), F.create_map(item, count))


def cart_decreased(cart: Column, item: Column) -> Column:
    """The cart with one less of an item; the last one removes it."""
    less = F.transform_values(cart, lambda k, v: F.when(k == item, v - 1).otherwise(v))
    return F.map_filter(less, lambda _, v: v > 0)


def folded_carts(actions: DataFrame, *order: str) -> DataFrame:
    """(userid, id, quantity) of carts after a log (userid, id, change) of actions in the given order: a change adds pieces, or takes some but not below none.

    A run of actions turns x into max(a, x + b), and such functions compose, so
    a log is folded in parts: with sums S of changes and no piece at first, the
    end is S - min(0, least S on the way). The log is dealt by ranges of (user,
    item, order), which may cut those of a frequent pair; each part keeps its
    sum and least sum, and the parts of a pair are few. Pairs without a piece
    have no row; actions with a null do nothing.
    """
    rows = actions.filter("userid IS NOT NULL AND id IS NOT NULL AND change IS NOT NULL")
    dealt = rows.repartitionByRange("userid", "id", *order).select("userid", "id", "change", *order, F.spark_partition_id().alias("part"))
    own = W.partitionBy("part", "userid", "id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    parts = stored(dealt, "actions").withColumn("s", F.sum("change").over(own)).groupBy("userid", "id", "part").agg(F.sum("change").alias("went"), F.min("s").alias("least"))
    before = F.sum("went").over(W.partitionBy("userid", "id").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("went")
    folded = parts.withColumn("low", before + F.col("least")).groupBy("userid", "id").agg((F.sum("went") - F.least(F.lit(0), F.min("low"))).alias("quantity"))
    return folded.filter("quantity > 0")


def date_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def text_date(text: Column) -> Column:
    return F.to_date(text, "yyyy-MM-dd")


def receipts(carts: DataFrame, order: str) -> DataFrame:
    """Carts (items, totalprice) as receipts with ids from 1 in the given order, all pending, at the present time."""
    rows = numbered(carts, [order], "id").withColumns({"timeofshopping": F.localtimestamp(), "orderStatus": F.lit(STATUSES[0])})
    return rows.select("id", "items", "timeofshopping", "totalprice", "orderStatus")
