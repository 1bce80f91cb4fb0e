import json

from mise.plans import extract as X


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_next_data(spark):
    doc = {"title": "<b>Stew</b>", "yields": "4", "recipeTimeNote": "", "headnote": "Warm ***up***",
           "metaData": {"fields": {"description": "Line1\nLine2", "source": ""}},
           "ingredientGroups": [{"fields": {"title": "A", "recipeIngredientItems": [
               {"fields": {"qty": "1", "preText": "", "postText": ", diced",
                           "ingredient": {"fields": {"title": "onion"}}}}]}},
               {"fields": {"title": "B", "recipeIngredientItems": [{"fields": {"qty": "2", "preText": "tbsp",
                                                                               "postText": ""}}]}}],
           "instructions": [{"fields": {"content": "<p>Cook\nslowly.</p>"}}]}
    html = ('<script id="__NEXT_DATA__">' + json.dumps(
        {"props": {"initialState": {"content": {"documents": {"z9": doc, "a1": {"title": "other"}}}}}}) + "</script>")
    r = X.extract(pages(spark, [(1, "https://www.cookscountry.com/r/1", html)])).collect()[0].recipe
    assert r.title == "Stew" and r.totaltime == "TBD" and r.author == "Cook's Country"
    assert r.description == "Line1 Line2"
    assert [(g.title, list(g.ingredients)) for g in r.ingredient_groups] == [("A", ["1 onion, diced"]), ("B", ["2 tbsp"])]
    assert r.direction_groups[0].directions == ["Cook slowly."]
    assert r.notes == ["Warm ***up***"]


def test_inline_store(spark):
    content = {"hed": "Pie", "dek": "<p>Sweet</p>", "formattedPrepTime": "PT10M", "formattedCookTime": "PT1H",
               "author": [{"name": "Bo"}], "ingredientGroups": [{"hed": "X", "ingredients": [{"description": "flour"}]}],
               "preparationGroups": [{"hed": "Y", "steps": [{"description": "Bake"}]}]}
    line = ('root.__INITIAL_STATE__.store = {"v":{"email":{"regExp":/a/,"password":{"regExp":/b/,'
            '"messages":{}}},"content":' + json.dumps(content) + "};")
    html = "<script>\nvar x=1;\n" + line + "\n</script>"
    r = X.extract(pages(spark, [(1, "https://www.epicurious.com/r/1", html)])).collect()[0].recipe
    assert (r.title, r.description, r.author) == ("Pie", "Sweet", "Epicurious (Bo)")
    assert (r.preptime, r.cooktime, r.totaltime) == ("10 minutes", "1 hour ", "1 hour 10 minutes")
    assert r.ingredient_groups[0].title == "" and r.ingredient_groups[0].ingredients == ["flour"]


def test_dom_layouts(spark):
    a = ('<h1 class="entry-title">Rice — Plain</h1><div property="description"><p>Good</p></div>'
         '<div class="yield"><span>Serves 2</span></div><div class="cook-time"><meta content="PT30M"></div>'
         '<ul><li class="ingredient">rice\n</li><li class="ingredient"> water </li></ul>'
         '<ol><li class="instruction">Boil</li></ol>')
    b = ('<title>Tacos | SAM THE COOKING GUY</title><div class="sqs-block"><div class="sqs-block-content">'
         '<p>Makes 4</p><p>Crunchy</p><ul><li>shells</li><li class="x">skip</li></ul></div></div>')
    rows = {r.page_id: r for r in X.extract(pages(spark, [(1, "https://www.saveur.com/a", a),
                                                          (2, "https://www.thecookingguy.com/b", b),
                                                          (3, "https://www.saveur.com/c", "<p>nothing</p>")])).collect()}
    ra = rows[1].recipe
    assert ra.title == "Rice   Plain" and ra.ingredient_groups[0].ingredients == ["rice", "water"]
    assert (ra.cooktime, ra.totaltime, ra.author) == ("30 minutes", "30 minutes", "Saveur")
    rb = rows[2].recipe
    assert rb.title == "Tacos " and rb["yield"] == "Makes 4" and rb.description == "Crunchy"
    assert rb.ingredient_groups[0].ingredients == ["shells"] and rb.direction_groups[0].directions == ["shells"]
    assert rb.totaltime is None
    assert rows[3].reason == "dom_field_missing"


def _py_store_content(html):
    """Plain statement of the store rule: last store line, trimmed to the outer braces."""
    import re
    hits = [ln for body in re.findall(r"(?is)<script[^>]*>(.*?)</script>", html)
            for ln in body.splitlines() if "root.__INITIAL_STATE__.store" in ln]
    if not hits:
        return None
    ln = hits[-1]
    ln = ln[:ln.rfind("}") + 1] if "}" in ln else ""
    ln = ln[ln.find("{"):] if "{" in ln else ""
    try:
        content = json.loads(ln).get("content")
    except ValueError:
        return None
    return None if content is None else json.dumps(content, separators=(",", ":"))


def test_inline_store_brace_trim(spark):
    from pyspark.sql import functions as F
    from mise.operators import sites as S
    long_text = "x" * 5000
    lines = [
        'root.__INITIAL_STATE__.store = {"content":{"a":1}};  // trailing } no',
        'root.__INITIAL_STATE__.store = {"content":{"t":"' + long_text + '"}} ; tail without braces',
        'root.__INITIAL_STATE__.store = no braces at all',
        'prefix {"content":{"n":[1,2]}} root.__INITIAL_STATE__.store',
    ]
    rows = [(i, "u", "<script>\n" + ln + "\n</script>") for i, ln in enumerate(lines)]
    df = pages(spark, rows).select("page_id", S.inline_store_content(F.col("html")).alias("c"))
    got = {r.page_id: (None if r.c is None else json.dumps(json.loads(r.c), separators=(",", ":")))
           for r in df.collect()}
    assert got == {i: _py_store_content(h) for i, _, h in rows}


def test_dom_page_without_a_time_value_is_rejected(spark):
    a = ('<h1 class="entry-title">Rice</h1><div property="description">d</div><div class="yield"><span>2</span></div>'
         '<div class="cook-time"><meta {0}></div><li class="ingredient">rice</li>')
    got = X.extract(pages(spark, [(1, "https://www.saveur.com/a", a.format("")), (2, "https://www.saveur.com/b", a.format("content=PT5M")),
                                  (3, "https://www.saveur.com/c", a.format('content=""'))])).collect()
    assert {r.page_id: r.reason for r in got} == {1: "dom_field_missing", 2: None, 3: None}


def test_dom_layout_b_lists(spark):
    """The first list in a content block, its class-less items at any depth; else the editor's list of the first block."""
    head = "<title>T</title><div class='sqs-block x'><div class='sqs-block-content'><p>one<p>two"
    nested = head + "<ul><li>a<ul><li>b</ul><li class=''>c</ul></div></div><ul><li>outside</ul>"
    fallback = head + "<ul class=k><li class=k>no</ul><ul data-rte-list=default><li>yes</li></ul></div></div>"
    second = head + "<ul><li class=k>no</ul></div></div><div class='sqs-block-content'><ul data-rte-list=default><li>late</ul></div>"
    rows = [(i, f"https://www.thecookingguy.com/{i}", h) for i, h in enumerate((nested, fallback, second, head))]
    got = {r.page_id: r for r in X.extract(pages(spark, rows)).collect()}
    assert got[0].recipe.direction_groups[0].directions == ["ab", "b"] and got[0].recipe["yield"] == "one" and got[0].recipe.description == "two"
    assert got[1].recipe.direction_groups[0].directions == ["yes"]
    assert got[2].reason == got[3].reason == "dom_field_missing"
