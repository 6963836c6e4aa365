"""Rule processor: the trace of nodes that each item of a list runs through, and its messages.

Mode, threshold and options are known when the plan is built. The trace of an
item is then a function of the item alone, so the whole trace is a prefix, the
items' arrays in order, and a suffix.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schema of items: position, and presence and kind of the two fields.
ITEMS = "item_pos long, is_null boolean, has_value boolean, value_is_int boolean, value int, has_category boolean, category string"
GAMMA_STEPS = 3


def nodes(*k: int) -> Column:
    return F.array(*[F.lit(x) for x in k]) if k else F.array().cast("array<int>")


def _said(*parts: Column | str) -> Column:
    return F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _either(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def _alpha(threshold: int, options: Mapping[str, bool]) -> tuple[Column, Column]:
    v = F.col("value").cast("long")
    high = (nodes(11, 12, 13), _said("Alpha: High value doubled: ", v * 2)) if options.get("doubleHighAlpha", False) else (nodes(11, 12, 14), _said("Alpha: High value: ", v))
    more = 10 if options.get("addLowAlpha") else 5
    low = (nodes(11, 15, 16), _said("Alpha: Low value adjusted: ", v + more)) if "addLowAlpha" in options else (nodes(11, 15, 17), _said("Alpha: Low value: ", v))
    pick = lambda k, same: F.when(v > threshold, high[k]).when(v < threshold, low[k]).otherwise(same)
    return F.concat(pick(0, nodes(11, 18)), nodes(19)), pick(1, _said("Alpha: Threshold value: ", v))


def _beta(options: Mapping[str, bool]) -> tuple[Column, Column]:
    v, c = F.col("value").cast("long"), F.lower(F.coalesce("category", F.lit("")))
    special = (nodes(20, 21, 22, 23), _said("Beta: Special category, negated value: ", -v)) if options.get("negateSpecialBeta", False) else (nodes(20, 21, 22, 24), _said("Beta: Special category: ", v))
    pick = lambda k, normal, unknown, missing: F.when(~F.col("has_category"), missing).when(c == "special", special[k]).when(c == "normal", normal).otherwise(unknown)
    trace = pick(0, nodes(20, 21, 25), nodes(20, 21, 26), nodes(20, 27))
    return F.concat(trace, nodes(28)), pick(1, _said("Beta: Normal category: ", v), _said("Beta: Unknown category."), _said("Beta: No category provided."))


def _gamma(threshold: int, options: Mapping[str, bool]) -> tuple[Column, Column]:
    v = F.col("value").cast("long")
    trace, said, going = [nodes(29)], [], F.lit(True)
    for j in range(GAMMA_STEPS):
        high, low = v > threshold + 5 * j, v < threshold - 5 * j
        flag = options.get("flagGamma", False)
        over = nodes(30, 31, 32, 36) if flag else nodes(30, 31, 33, 36)
        trace.append(_either(~going, nodes(), F.when(high, over).when(low, nodes(30, 34, 36)).otherwise(nodes(30, 35))))
        loop = f"Gamma: Loop {j + 1}, "
        text = F.when(high, _said(loop + ("High value with flag." if flag else "High value."))).when(low, _said(loop + "Low value.")).otherwise(_said(loop + "Within range."))
        said.append(_either(~going, F.array().cast("array<string>"), text))
        going = going & (high | low)  # a value in range ends the loop
    return F.concat(*trace, nodes(37)), F.concat(*said)


def item_traces(items: DataFrame, mode: str, threshold: int, options: Mapping[str, bool]) -> DataFrame:
    """items with `trace array<int>` and `messages array<string>`.

    Null items and those without a value run through 7, values that are no
    integer through 9; both skip the rest.
    """
    kinds = {"alpha": lambda: _alpha(threshold, options), "beta": lambda: _beta(options), "gamma": lambda: _gamma(threshold, options)}
    trace, said = kinds[mode]() if mode in kinds else (nodes(38), _said("Error: Invalid processing mode encountered."))
    tail = (39, 40, 41) if options.get("logAll", False) else (39, 41)
    missing = F.col("is_null") | ~F.col("has_value")
    odd = ~F.col("value_is_int") | F.col("value").isNull()
    whole = F.when(missing, nodes(6, 7)).when(odd, nodes(6, 8, 9)).otherwise(F.concat(nodes(6, 8, 10), trace, nodes(*tail)))
    if options.get("logAll", False):
        category = F.when(F.col("has_category"), F.concat(F.lit("category="), F.coalesce("category", F.lit("null")), F.lit(", "))).otherwise("")
        said = F.concat(said, _said("Logged: {", category, "value=", F.col("value"), "}"))
    messages = F.when(missing, _said("Warning: Skipping invalid data item.")).when(odd, _said("Warning: Skipping item with non-integer value.")).otherwise(said)
    return items.withColumns({"trace": whole, "messages": messages})


def process(items: DataFrame, mode: str | None, threshold: int, options: Mapping[str, bool]) -> DataFrame:
    """The whole trace as rows (item_pos, k, node); sort by the first two.

    The prefix has item_pos -1, the suffix the greatest bigint. Without items
    the trace is 1, 2; without a mode it is 1, 3, 4.
    """
    spark = items.sparkSession
    ends = lambda pos, *own: spark.createDataFrame([(pos, k, n) for k, n in enumerate(own)], "item_pos long, k int, node int")
    if items.isEmpty():
        return ends(-1, 1, 2)
    if not mode:
        return ends(-1, 1, 3, 4)
    middle = item_traces(items, mode, threshold, options).select("item_pos", F.posexplode("trace").alias("k", "node"))
    return ends(-1, 1, 3, 5).unionByName(middle).unionByName(ends(2**63 - 1, 42))
