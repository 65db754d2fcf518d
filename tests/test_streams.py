"""Streams with state: several batches, restarts, what waits and what is left at the close."""

import pytest

from lotwise.streaming import stateful


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/stream"


def item(spark, *rows):
    return spark.createDataFrame(list(rows), stateful.ITEM)


def stored(stream):
    return sorted((r.key, r.seq, r.body) for r in stream.stored().collect())


def test_details_wait_and_go_with_their_parent(spark, folder):
    stream = stateful.ParentDetails(spark, folder)
    stream.feed(item(spark, ("early", 1, "detail", "a"), ("plain", 2, "parent", None), ("plain", 3, "detail", "b"), ("lost", 4, "detail", "c")))
    assert stored(stream) == [("plain", 3, "b")]
    again = stateful.ParentDetails(spark, folder)  # goes on from the checkpoint
    again.feed(item(spark, ("early", 5, "parent", None), ("early", 6, "detail", "d"), ("plain", 7, "detail", "e")))
    assert stored(again) == [("early", 1, "a"), ("early", 6, "d"), ("plain", 3, "b"), ("plain", 7, "e")]
    again.feed(item(spark, ("plain", 8, "parent", None), ("plain", 9, "detail", "f")))
    assert stored(again) == [("early", 1, "a"), ("early", 6, "d"), ("plain", 9, "f")]
    assert again.orphans().count() == 0
    again.close()
    assert [tuple(r) for r in again.orphans().collect()] == [("lost", 4, "c")]
    assert stored(again) == [("early", 1, "a"), ("early", 6, "d"), ("plain", 9, "f")]


def test_details_equal_their_rules_read_one_by_one(spark, folder):
    """Three batches of mixed items against the rules applied item by item; no Python runs for a key."""
    import random

    rng, stream = random.Random(5), stateful.ParentDetails(spark, folder)
    rows = [(f"k{rng.randrange(12)}", n, "parent" if rng.random() < 0.15 else "detail", f"b{n}") for n in range(180)]
    for k in range(0, 180, 60):
        stream.feed(item(spark, *rng.sample(rows[k : k + 60], 60)))
    stream.close()
    seen, waiting, kept = set(), {}, {}
    for key, seq, kind, body in rows:
        if kind == "parent":
            kept[key] = waiting.pop(key, [])
            seen.add(key)
        else:
            (kept if key in seen else waiting).setdefault(key, []).append((key, seq, body))
    assert stored(stream) == sorted(x for of in kept.values() for x in of)
    assert sorted((r.key, r.seq, r.body) for r in stream.orphans().collect()) == sorted(x for of in waiting.values() for x in of)
    assert "Python" not in stateful.follow(item(spark, *rows))._jdf.queryExecution().toString()


def test_late_rows_are_tried_once_more(spark, folder):
    stream = stateful.LateRows(spark, folder)
    stream.feed(item(spark, ("a", 1, "row", "early"), ("b", 2, "parent", None), ("b", 3, "row", "at once")))
    stream = stateful.LateRows(spark, folder)
    stream.feed(item(spark, ("a", 4, "parent", None), ("b", 5, "row", "later batch")))
    stream.feed(item(spark, ("c", 6, "row", "never")))
    assert {r.tries for r in stream.dead().collect()} == {1}
    stream.close()
    assert {r.batch: (r.accepted, r.queued) for r in stream.counts().collect()} == {0: (1, 1), 1: (1, 0), 2: (0, 1), -1: (1, 1)}
    assert sorted(r.body for r in stream.accepted().collect()) == ["at once", "early", "later batch"]
    assert [(r.body, r.tries) for r in stream.lost().collect()] == [("never", 2)]


def test_auction_sales(spark, folder):
    lots = lambda *rows: spark.createDataFrame(list(rows), stateful.LOT)
    details = lambda *rows: spark.createDataFrame(list(rows), stateful.DETAIL)
    stream = stateful.AuctionSales(spark, folder)
    stream.feed(lots(("1", "lot-1", 7, "", 100.0, 200.0, False, None, None)), details(("0", "lot-2", "ignored"), ("2", "lot-1", None), ("2", "lot-1", "A")))
    assert [(r.lots, r.currency, r.single_cellar) for r in stream.close().collect()] == [(1, None, True)]
    stream = stateful.AuctionSales(spark, folder)
    stream.feed(
        lots(("3", "lot-2", 7, "USD", 300.9, 400.0, True, 350.5, 1.5), ("4", "lot-3", 7, "EUR", None, None, True, 350.0, 2.0), ("5", "lot-9", 8, None, 1.0, 1.0, True, 0.0, 1.0)),
        details(("6", "lot-2", "A"), ("2", "lot-3", "early")))
    got = {r.auction_id: r for r in stream.close().collect()}
    r = got[7]
    assert (r.lots, r.sold, r.currency, r.total_low_estimate, r.total_high_estimate, r.total_sales, r.volume_sold, r.top_lot, r.single_cellar) == (3, 2, "USD", 400, 600, 700, 3.5, "lot-2", True)
    assert (got[8].lots, got[8].top_lot, got[8].currency, got[8].sale_type, got[8].ex_ch) == (1, None, None, "PAST", False)
    stream.feed(lots(), details(("7", "lot-3", "B")))
    assert {r.auction_id: r.single_cellar for r in stream.close().collect()} == {7: False, 8: True}


def test_state_of_the_auction_stream_is_kept_on_disk(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = stateful.AuctionSales(spark, f"file://{tmp_path}/stream")
    stream.feed(spark.createDataFrame([("1", "lot-1", 7, "USD", 1.0, 2.0, False, None, None)], stateful.LOT), spark.createDataFrame([], stateful.DETAIL))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    for name in ("checkpoint", "checkpoint-details"):
        assert "RocksDBStateStoreProvider" in (tmp_path / "stream" / name / "offsets" / "0").read_text()


def test_auction_stream_meets_earlier_batches_without_a_store_of_keys(spark, tmp_path):
    """Lots and details in any batch, lots sent again for another auction, equal arrivals, against the rule for each pair; a
    batch that runs again changes nothing, and no stream keeps state key by key."""
    import random

    rng, folder = random.Random(11), f"file://{tmp_path}/stream"
    lots = [(f"{rng.randrange(60):02d}", f"lot-{rng.randrange(25)}", rng.choice([1, 2, 3, None]), rng.choice([None, "", "USD", "EUR"]), 10.7, None, rng.choice([True, False, None]), rng.choice([None, 0.5, 70.0, 90.0]), rng.choice([None, 1.5])) for _ in range(60)]
    details = [(rng.choice([None, *[f"{n:02d}" for n in range(60)]]), rng.choice([None, *[f"lot-{n}" for n in range(30)]]), rng.choice([None, "A", "A", "A", "B"])) for _ in range(50)]
    stream = stateful.AuctionSales(spark, folder)
    for some, more in ((lots[::3], details[1:30:3]), ([], details[31::3]), (lots[1::3], details[2::3]), (lots[2:30:3], []), (lots[32::3], details[::3])):
        stream.feed(spark.createDataFrame(some, stateful.LOT), spark.createDataFrame(more, stateful.DETAIL))
        stream = stateful.AuctionSales(spark, folder)
    first = sorted(stream.close().collect(), key=str)
    for auction in (1, 2, 3, None):
        mine = [x for x in lots if x[2] == auction]
        told = {d[2] for d in details for x in mine if d[2] and d[0] and d[1] == x[1] and d[0] > x[0]}
        sold = [x for x in mine if x[6]]
        top = min(((-int(x[7] or 0), x[0], x[1]) for x in sold if int(x[7] or 0) > 0), default=(0, "", None))[2]
        named = [(x[0], x[3]) for x in mine if x[3]]
        r = next(r for r in first if r.auction_id == auction)
        assert (r.lots, r.sold, r.single_cellar, r.top_lot, r.total_low_estimate, r.total_high_estimate) == (len(mine), len(sold), len(told) <= 1, top, 10 * len(mine), 0)
        assert (r.currency, r.total_sales, r.volume_sold) == (min(named)[1], sum(int(x[7] or 0) for x in sold), sum(x[8] or 0.0 for x in sold))
    assert len({r.single_cellar for r in first}) == 2
    assert not [p for name in ("checkpoint", "checkpoint-details") for p in (tmp_path / "stream" / name / "state").glob("*")]
    # batch 2 runs again, as after a loss before its commit
    stream.meet(spark.createDataFrame([(x[1], x[0], x[2], None) for x in lots[1::3]], "lot_id string, seq string, auction_id long, lot_producer string").unionByName(spark.createDataFrame([(d[1], d[0], None, d[2]) for d in details[2::3] if d[0] and d[1] and d[2]], "lot_id string, seq string, auction_id long, lot_producer string")), 2)
    stream.add(spark.createDataFrame(lots[1::3], stateful.LOT), 2)
    assert sorted(stream.close().collect(), key=str) == first
