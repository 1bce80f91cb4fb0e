"""Flat item rows to nested lists: the inverse of flattening."""
import random

import pytest
from pyspark.sql import functions as F

from mise.operators import recipes as R

FLAT = "page_id bigint, section string, group_pos int, group_title string, item_no int, item string"


def flat(spark, rows):
    return spark.createDataFrame(rows, FLAT)


def nested(df, **kw):
    return {r.page_id: ([(g.title, list(g.ingredients)) for g in r.ingredient_groups], [(g.group, list(g.directions)) for g in r.direction_groups])
            for r in R.nest_items(df, **kw).collect()}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_inverse_of_flatten_items(spark, chunk):
    rnd = random.Random(chunk)
    recipes, want = [], {}
    for i in range(60):
        groups = [{"title": "", "ingredients": [f"i{k}" for k in range(rnd.randint(1, 12))]} for _ in range(rnd.randint(0, 4))]
        if len(groups) > 1:
            groups = [{**g, "title": f"t{k}"} for k, g in enumerate(groups)]
        steps = [{"group": rnd.choice(["", "g"]), "directions": [rnd.choice(["x", "", None]) for _ in range(rnd.randint(1, 12))]} for _ in range(rnd.randint(0, 2))]
        recipes.append((i, {"ingredient_groups": groups, "direction_groups": steps}))
        if groups or steps:
            want[i] = ([(g["title"], g["ingredients"]) for g in groups], [(g["group"], g["directions"]) for g in steps])
    df = spark.createDataFrame(recipes, f"page_id bigint, recipe struct<{R.RECIPE_DDL}>")
    assert nested(R.flatten_items(df).orderBy(F.rand(chunk)), chunk=chunk) == want


def test_ties_gaps_nulls_and_titles(spark):
    rows = [(1, "ingredients", 7, "Only", 30, "c"), (1, "ingredients", 7, "Only", 2, "b"), (1, "ingredients", 7, None, 2, "a"), (1, "ingredients", 7, "Only", 2, None),
            (1, "ingredients", 7, "Only", 2, "b"), (None, "directions", 0, "", 1, "no key"), (2, "ingredients", 0, "", 1, "x"), (2, "ingredients", 5, "Later", 1, "y"),
            (3, "other", 0, "", 1, "z")]
    assert nested(flat(spark, rows)) == {1: ([("", [None, "a", "b", "b", "c"])], []), None: ([], [("", ["no key"])]),
                                         2: ([("", ["x"]), ("Later", ["y"])], []), 3: ([], [])}
    assert nested(flat(spark, [])) == {}


def test_one_page_with_a_third_of_all_rows(spark):
    df = spark.range(90_000).selectExpr("if(id % 3 = 0, 0, id) as page_id", "'ingredients' as section", "0 as group_pos", "'' as group_title",
                                        "cast(id as int) as item_no", "cast(id as string) as item")
    got = R.nest_items(df).where("page_id = 0").first().ingredient_groups[0].ingredients
    assert got == [str(i) for i in range(0, 90_000, 3)]


def test_items_cross_the_disk_once(spark, capsys):
    """One shuffle for all levels; a caller's own deal of the rows stays a shuffle of its own."""
    df = flat(spark, [(1, "ingredients", 0, "", 1, "x"), (1, "directions", 0, "", 1, "y")])
    for rows, shuffles in [(df, 1), (df.repartition("item"), 2)]:
        R.nest_items(rows).explain()
        assert capsys.readouterr().out.count("Exchange hashpartitioning") == shuffles
        assert nested(rows) == {1: ([("", ["x"])], [("", ["y"])])}
