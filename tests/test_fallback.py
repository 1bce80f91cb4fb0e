"""The second extractor (microdata) and the fall-through between extractors."""
import json

import pytest

from mise.operators import microdata as MD
from mise.plans import extract as X

RECIPE = '<div itemscope itemtype="http://schema.org/Recipe">{}</div>'
FULL = RECIPE.format('<h1 itemprop="name">A &amp; B</h1><ul><li itemprop="ingredients">one<li itemprop="recipeIngredient"> two  spoons</ul>'
                     '<div itemprop="recipeInstructions">Mix<br>Bake<p>Serve</p></div><meta itemprop="totalTime" content="PT1H5M">'
                     '<span itemprop="yield recipeYield">4</span>')


def test_values_of_an_item():
    assert MD.read_item(FULL) == (None, "A & B", "4", "PT1H5M", ["one", "two spoons"], ["Mix", "Bake", "Serve"])


@pytest.mark.parametrize("html", ["", "<p>no item</p>", '<div itemscope itemtype="https://schema.org/Person"><b itemprop="name">x</b></div>',
                                  '<div itemscope itemtype="https://schema.org/RecipeBook"></div>', "<![bad", "<div itemscope"])
def test_pages_without_a_recipe_item(html):
    assert MD.read_item(html)[0] == MD.REASON_NO_MICRODATA


def test_an_incomplete_item_is_no_recipe():
    assert MD.read_item(RECIPE.format('<b itemprop="name">x</b>'))[0] == MD.REASON_INCOMPLETE


def test_nested_and_later_items_keep_their_properties():
    nested = RECIPE.format('<div itemprop="author" itemscope><b itemprop="name">Cook</b><i itemprop="ingredients">no</i></div>'
                           '<b itemprop="name">Own</b><i itemprop="ingredients">yes</i>'
                           '<ol itemprop="recipeInstructions"><li itemscope itemprop="step"><b itemprop="name">n</b> one</li><li>two</li></ol>')
    got = MD.read_item(nested + FULL)
    assert (got[1], got[4], got[5]) == ("Own", ["yes"], ["n one", "two"])


def test_a_very_long_page_is_read_in_one_pass():
    many = "".join(f'<li itemprop="recipeIngredient">i{k}</li>' for k in range(50000))
    got = MD.read_item(RECIPE.format('<b itemprop="name">x</b>' + many + '<p itemprop="recipeInstructions">y</p>'))
    assert len(got[4]) == 50000


def ld(**fields):
    body = {"@type": "Recipe", "name": "Json", "recipeIngredient": ["water"], "recipeInstructions": "Boil.", **fields}
    return '<script type="application/ld+json">' + json.dumps({k: v for k, v in body.items() if v != "-"}) + "</script>"


def store(ok=True):
    return ('<script>\nroot.__INITIAL_STATE__.store = {"content":{"hed":"Store","ingredientGroups":[],"preparationGroups":[]}'
            + ("}" if ok else "") + ";\n</script>")


# url, html, default: (extractor, title or reason), forced: the same
CASES = [
    ("https://a.example/1", ld(), ("ldjson", "Json"), ("ldjson", "Json")),
    ("https://a.example/2", FULL, ("microdata", "A & B"), ("microdata", "A & B")),
    ("https://a.example/3", ld() + FULL, ("ldjson", "Json"), ("microdata", "A & B")),
    ("https://a.example/4", "<p>nothing</p>", (None, "no_ldjson"), (None, "no_ldjson")),
    ("https://a.example/5", ld(recipeInstructions="-") + FULL, (None, "no_instructions"), ("microdata", "A & B")),
    ("https://a.example/6", ld(**{"@type": "Person"}) + FULL, ("microdata", "A & B"), ("microdata", "A & B")),
    ("https://a.example/7", FULL.replace("A &amp; B", "<i>&nbsp;</i>&lt;b&gt;"), (None, "empty_title"), (None, "empty_title")),
    ("https://www.epicurious.com/1", store(), ("inline_store", "Store"), ("inline_store", "Store")),
    ("https://www.epicurious.com/2", store() + FULL, ("inline_store", "Store"), ("microdata", "A & B")),
    ("https://www.epicurious.com/3", store(False) + FULL, (None, "no_inline_store"), ("microdata", "A & B")),
    ("https://www.cookscountry.com/1", FULL, (None, "no_next_data"), (None, "no_next_data")),
    ("https://www.saveur.com/1", FULL, (None, "dom_field_missing"), (None, "dom_field_missing")),
    ("https://a.example/8", None, (None, "no_ldjson"), (None, "no_ldjson")),
]


@pytest.mark.parametrize("mode,place", [("default", 2), ("forced", 3)])
def test_fall_through(spark, mode, place):
    pages = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.extractor, r.recipe.title if r.recipe else r.reason) for r in X.extract(pages, fallback=mode).collect()}
    assert got == {i: c[place] for i, c in enumerate(CASES)}


def test_fields_the_second_extractor_sets(spark):
    pages = spark.createDataFrame([(1, "https://a.example/2", FULL)], "page_id bigint, url string, html string")
    r = X.extract(pages, fallback="default").first().recipe
    assert (r.url, r.totaltime, r["yield"], r.author, r.description, r.preptime) == ("https://a.example/2", "1 hour 5 minutes", "4", None, "", "")


def test_the_plain_extraction_never_asks_it(spark):
    pages = spark.createDataFrame([(1, "https://a.example/2", FULL)], "page_id bigint, url string, html string")
    out = X.extract(pages)
    assert out.first().reason == "no_ldjson" and "extractor" not in out.columns
    assert "microdata_fields" not in out._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        X.extract(pages, fallback="sometimes")
