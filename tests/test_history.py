from tamarisk import queries


def test_price_change_sizes_gathers_no_pairs(spark, sf):
    plan = queries.price_change_sizes(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # The last 20 sizes are the only limit.
    assert plan.count("GlobalLimit") == 1
