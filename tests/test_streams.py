"""Carts of a stream equal those folded from the whole log."""

import json
import random

from geobucket.functions import store as S
from geobucket.streaming.carts import cart_stream


def test_carts_of_a_stream(spark, tmp_path):
    r, at, log = random.Random(2), 0, []
    schema = "userid int, id int, change int, at int"
    (tmp_path / "in").mkdir()
    shown, want = {}, {}
    for batch in range(3):
        rows = []
        for _ in range(60):
            at += 1
            rows.append({"userid": r.randrange(3), "id": r.randrange(2), "change": r.choice([1, 1, -1, -2]), "at": at})
        rows.append({"userid": None, "id": 1, "change": 5, "at": at})
        r.shuffle(rows)
        (tmp_path / "in" / f"{batch}.json").write_text("\n".join(map(json.dumps, rows)))
        log += rows
        stream = cart_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        seen = []
        stream.writeStream.outputMode("update").foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        shown |= {(x.userid, x.id): x.quantity for x in seen}
    for x in sorted((x for x in log if x["userid"] is not None), key=lambda x: x["at"]):
        want[x["userid"], x["id"]] = max(0, want.get((x["userid"], x["id"]), 0) + x["change"])
    assert shown == want
    whole = S.folded_carts(spark.createDataFrame([(x["userid"], x["id"], x["change"], x["at"]) for x in log], schema), "at").collect()
    assert {(x.userid, x.id): x.quantity for x in whole} == {k: v for k, v in want.items() if v}
