"""Carts kept up to date by a stream of actions: the state of a (user, item) is its number of pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CART = "userid int, id int, quantity long"


def cart_stream(actions: DataFrame, order: str = "at") -> DataFrame:
    """(userid, id, quantity) after each micro-batch, for the pairs that it changes, of a stream (userid, id, change, order).

    A change adds pieces, or takes some but not below none, as in
    store.folded_carts; actions of a micro-batch are taken in order, later
    batches after earlier ones. Of a frequent pair, its own actions of a batch
    go through one task. Actions with a null do nothing.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches)).sort_values(order)
        pieces = state.get[0] if state.exists else 0
        # with sums S of changes from x pieces, the end is x + S - min(0, least x + S on the way)
        sums = pieces + own["change"].cumsum()
        pieces = int(sums.iloc[-1] - min(0, sums.min()))
        state.update((pieces,))
        yield pd.DataFrame({"userid": [key[0]], "id": [key[1]], "quantity": [pieces]})

    rows = actions.filter("userid IS NOT NULL AND id IS NOT NULL AND change IS NOT NULL")
    return rows.groupBy("userid", "id").applyInPandasWithState(fold, CART, "quantity long", "update", GroupStateTimeout.NoTimeout)
