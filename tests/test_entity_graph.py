import pytest

from cadence.operators.entity_graph import EntityGraph


def _graph(spark):
    shops = spark.createDataFrame([(1, "north"), (2, "south"), (3, "south")], "shop int, side string")
    users = spark.createDataFrame([(10, "m"), (11, None)], "user int, kind string")
    sales = spark.createDataFrame([(100, 1, 10, 11, 5.0), (101, 1, 11, 10, 7.0), (102, 2, 10, 10, None), (103, None, 10, 11, 9.0)],
                                  "sale int, shop int, buyer int, seller int, price double")
    items = spark.createDataFrame([(1000, 100, 2), (1001, 100, 3), (1002, 102, 4)], "item int, sale int, amount int")
    return EntityGraph().entity("shops", shops, "shop").entity("users", users, "user").entity("sales", sales, "sale").entity("items", items, "item") \
        .relate("shops", "shop", "sales", "shop").relate("users", "user", "sales", "buyer").relate("users", "user", "sales", "seller") \
        .relate("sales", "sale", "items", "sale")


def test_two_relations_between_two_entities_and_two_levels(spark):
    got = {r["user"]: r for r in _graph(spark).synthesize("users", 2).collect()}
    assert (got[10]["COUNT(sales[buyer])"], got[10]["COUNT(sales[seller])"], got[11]["COUNT(sales[buyer])"]) == (3, 2, 1)
    assert got[10]["SUM(sales[buyer].price)"] == 14.0 and got[11]["SUM(sales[seller].price)"] == 14.0
    assert got[10]["SUM(sales[buyer].COUNT(items))"] == 3.0 and got[10]["MAX(sales[seller].SUM(items.amount))"] == 4.0


def test_depth_bounds_the_aggregations(spark):
    one, two = (_graph(spark).synthesize("shops", d).columns for d in (1, 2))
    assert "SUM(sales.price)" in one and not any("items" in c for c in one)
    assert "SUM(sales.SUM(items.amount))" in two and _graph(spark).synthesize("shops", 0).columns == ["shop", "side"]
    assert not any("shop)" in c or "buyer)" in c for c in two)


def test_parents_give_their_own_columns(spark):
    rows = {r["sale"]: r for r in _graph(spark).synthesize("sales", 1).collect()}
    assert rows[100]["users[buyer].kind"] == "m" and rows[100]["users[seller].kind"] is None
    assert rows[100]["shops.side"] == "north" and rows[103]["shops.side"] is None
    assert rows[101]["COUNT(items)"] == 0 and rows[101]["SUM(items.amount)"] is None
    assert len(rows) == 4
    assert "shops.side" not in _graph(spark).synthesize("sales", 1, direct=False).columns


def test_features_are_encoded_and_complete(spark):
    rows = {r["shop"]: r for r in _graph(spark).features("shops", 2).collect()}
    assert rows[2]["side = south"] == 1 and rows[1]["side = south"] == 0
    assert rows[3]["SUM(sales.price)"] == 12.0        # the mean of what is known: shop 1 alone
    sales = _graph(spark).features("sales", 1)
    assert "shops side = north" in sales.columns


def test_circles_and_unknown_columns_raise(spark):
    g = _graph(spark)
    with pytest.raises(ValueError, match="no column"):
        g.relate("shops", "nothing", "sales", "shop")
    with pytest.raises(ValueError, match="circle"):
        g.relate("items", "item", "shops", "shop").synthesize("shops", 4)
