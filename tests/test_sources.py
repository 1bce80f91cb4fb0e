import json

from mise.plans import extract as X
from mise.sources import recipe_json as RJ
from mise.sources.tables import scan_page_files


def test_crawl_folder_to_recipe(spark, tmp_path):
    """One HTML file per page: page id from the path, whole file text, then extraction."""
    rec = {"@type": "Recipe", "name": "Folder Soup", "recipeIngredient": ["water"], "recipeInstructions": "Boil."}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.html").write_text(
        '<html><script type="application/ld+json">' + json.dumps(rec) + "</script></html>", encoding="utf-8")
    (tmp_path / "two.html").write_text("<html>nothing here</html>", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("not a page", encoding="utf-8")
    pages = scan_page_files(spark, str(tmp_path))
    got = {r.url.rsplit("/", 1)[-1]: (r.recipe.title if r.recipe else None, r.reason)
           for r in X.extract(pages).collect()}
    assert got == {"one.html": ("Folder Soup", None), "two.html": (None, "no_ldjson")}
    assert pages.select("page_id").distinct().count() == 2


def test_pretty_recipe_file_round_trip(spark, tmp_path):
    """A stored, pretty-printed recipe record reads back into the recipe struct."""
    rec = {"url": "https://x.example/r", "title": "Kept", "yield": "2", "totaltime": "1 hour ",
           "ingredient_groups": [{"title": "", "ingredients": ["a", "b"]}],
           "direction_groups": [{"group": "", "directions": ["mix"]}]}
    (tmp_path / "r.json").write_text(json.dumps(rec, indent=4), encoding="utf-8")
    r = RJ.scan_recipe_json(spark, str(tmp_path / "r.json"), multi_line=True).collect()
    assert len(r) == 1
    got = r[0].recipe
    assert (got.title, got["yield"], got.totaltime) == ("Kept", "2", "1 hour ")
    assert list(got.ingredient_groups[0].ingredients) == ["a", "b"]
    assert got.notes is None


def test_crawl_folder_with_a_url_index(spark, tmp_path):
    """Pages keep their own addresses: domain, publisher and route follow."""
    rec = {"@type": "Recipe", "name": "Soup", "recipeIngredient": ["water"], "recipeInstructions": "Boil."}
    (tmp_path / "a").mkdir()
    for name in ("a/one.html", "two.html"):
        (tmp_path / name).write_text('<script type="application/ld+json">' + json.dumps(rec) + "</script>", encoding="utf-8")
    index = spark.createDataFrame([("a/one.html", "https://www.bonappetit.com/r/1")], "file string, url string")
    got = {r.url: (r.publisher, r.route) for r in X.extract(scan_page_files(spark, str(tmp_path), url_index=index)).collect()}
    assert got["https://www.bonappetit.com/r/1"] == ("Bon Appetit", "ldjson") and len(got) == 2


def test_stored_records_without_a_key_stay_apart(spark, tmp_path):
    from mise.operators import render as RD
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"title": f"Dish {i % 2}", "description": f"d{i}"}), encoding="utf-8")
    kept = RJ.scan_recipe_json(spark, str(tmp_path))
    assert kept.where("page_id is null").count() == 0 and kept.select("page_id").distinct().count() == 3
    won = RD.filename_collision(RD.render_docs(kept, ["md"])).collect()
    assert {r.filename: r.n_candidates for r in won} == {"Dish0.md": 2, "Dish1.md": 1} and all(r.body for r in won)
