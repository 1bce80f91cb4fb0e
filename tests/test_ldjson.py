import json
import random

from pyspark.sql import functions as F

from mise.functions import jsonkeys as J
from mise.plans import extract as X
from mise.operators import ldjson as L


def script(body, quote='"'):
    return f"<script type={quote}application/ld+json{quote}>\n  {body}\n</script>"


RECIPE = {"@type": "Recipe", "name": " <b>Soup</b> ", "recipeIngredient": ["1 &frac12; cups <i>water</i>", "salt"],
          "recipeInstructions": [{"@type": "HowToStep", "text": "Boil."}, "Serve.", {"@type": "HowToStep"}],
          "totalTime": "PT1H", "cookTime": "PT20M", "recipeYield": ["2", "4 bowls"],
          "author": [{"@type": "Person", "name": "Ann"}]}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_script_layouts_and_fold(spark):
    rec = json.dumps(RECIPE)
    site = json.dumps({"@type": "WebSite"})
    html = {
        1: script(rec),
        2: script(f"[{site}, {rec}]"),
        3: script(json.dumps({"@graph": [{"@type": "WebPage"}, RECIPE]})),
        4: script("{bad") + script(rec),
        5: script(f"[{site}]") + script(rec),            # list sets NULL, later object fills it
        6: script(rec) + script(f"[{site}]"),            # list after the recipe overwrites it with NULL
        7: "<html>no scripts</html>",
        8: script(json.dumps({"@type": "Recipe", "name": "x"})),  # no recipeIngredient
        9: script(rec, quote="'") + script(json.dumps(dict(RECIPE, name="second"))),  # first object wins
    }
    df = pages(spark, [(k, "https://www.bonappetit.com/r/" + str(k), v) for k, v in html.items()])
    ex = X.extract(df).collect()
    got = {r.page_id: (r.recipe.title if r.recipe else None, r.reason) for r in ex}
    assert got[1] == ("Soup", None) and got[2] == ("Soup", None) and got[3] == ("Soup", None)
    assert got[4] == ("Soup", None) and got[5] == ("Soup", None)
    assert got[6] == (None, "no_recipe_candidate")
    assert got[7] == (None, "no_ldjson")
    assert got[8] == (None, "no_recipe_candidate")
    assert got[9] == ("Soup", None)


def test_trailing_text_makes_script_malformed(spark):
    """A valid JSON value followed by more text does not parse as a whole: the
    script is skipped, as json.loads would reject it."""
    first = json.dumps(dict(RECIPE, name="first"))
    html = {
        1: script(first + " } junk") + script(json.dumps(RECIPE)),   # skipped, later object used
        2: script("[" + first + "] tail"),                             # malformed list
        3: script(first + "   "),                                      # whitespace is fine
    }
    df = pages(spark, [(k, "https://www.bonappetit.com/r/" + str(k), v) for k, v in html.items()])
    got = {r.page_id: (r.recipe.title if r.recipe else None, r.reason) for r in X.extract(df).collect()}
    assert got == {1: ("Soup", None), 2: (None, "no_recipe_candidate"), 3: ("first", None)}


def test_field_rules(spark):
    df = pages(spark, [(1, "https://www.bonappetit.com/r/1", script(json.dumps(RECIPE)))])
    r = X.extract(df).collect()[0].recipe
    assert r.ingredient_groups[0].ingredients == ["1 1/2 cups water", "salt"]
    assert r.ingredient_groups[0].title == ""
    assert r.direction_groups[0].directions == ["Boil.", "Serve.", '{"@type":"HowToStep"}']
    assert (r.preptime, r.cooktime, r.totaltime) == ("40 minutes", "20 minutes", "1 hour ")
    assert r["yield"] == "4 bowls"
    assert r.author == "Bon Appetit (Ann)"
    assert r.notes is None


def test_headline_key_presence_and_item_list(spark):
    rec = dict(RECIPE, headline=None,
               recipeInstructions=[{"@type": "HowToSection", "itemListElement": [{"text": "A"}, {"text": "B"}]},
                                   {"@type": "HowToSection", "itemListElement": [{"text": "C"}]}])
    rec2 = dict(RECIPE, headline="<em>Big</em>", author="Bon Appetit staff", totalTime="PT0M", prepTime="PT5M")
    df = pages(spark, [(1, "https://x.example/1", script(json.dumps(rec))),
                       (2, "https://www.bonappetit.com/2", script(json.dumps(rec2)))])
    rows = {r.page_id: r for r in X.extract(df).collect()}
    assert rows[1].reason == "empty_title"      # headline present but null: no fallback to name
    r2 = rows[2].recipe
    assert r2.title == "Big" and r2.author == "Bon Appetit staff"
    assert (r2.preptime, r2.totaltime) == ("5 minutes", "25 minutes")


def test_item_list_element_first_section_only(spark):
    rec = dict(RECIPE, recipeInstructions=[{"@type": "HowToSection", "itemListElement": [{"text": "A"}, {"text": "B"}]},
                                           {"@type": "HowToSection", "itemListElement": [{"text": "C"}]}])
    df = pages(spark, [(1, "https://x.example/1", script(json.dumps(rec)))])
    r = X.extract(df).collect()[0].recipe
    assert r.direction_groups[0].directions == ["A", "B"]
    assert r.author == "Ann"  # unknown publisher: author kept as is


def _dfs_first(node, key):
    """First value under a key in key order; a list's elements are entered only where they are objects."""
    for k, v in node.items():
        if k == key:
            return True, v
        for d in [v] if isinstance(v, dict) else [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []:
            found, value = _dfs_first(d, key)
            if found:
                return True, value
    return False, None


def _random_value(rnd, depth=0):
    r = rnd.random()
    if depth > 4 or r < 0.35:
        return rnd.choice([1, -2.5, True, None, "k", '"k":1', "a\\", '\\"', "x, y", "{", "]:[", "é🙂", ":", "", "k\\\\"])
    if r < 0.65:
        return {rnd.choice(["k", "a", "b", 'c"', "kk", ":k", "\\k", ""]): _random_value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))}
    return [_random_value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]


def test_key_search_equals_python_on_random_texts(spark):
    rnd = random.Random(2)
    docs = [json.dumps(_random_value(rnd), ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1]), separators=rnd.choice([None, (",", ":")]))
            for _ in range(1500)]
    docs += ['{"k":1,"a":{"k":2},"k":[3]}', '{"a":{"k":"x","b":1,"k":{"z" : [1, 2]}},"k":5}', '{"k" : null}', "{bad", "", '{"a":1} x', '[{"k":1}]',
             None, '  {"a":[[{"k":1}],{"k" :2}]}', '{"x":"k","k":"y"}', '{"a":' * 300 + '{"k":7}' + "}" * 300, '{"l":[' + '{"a":"k"},' * 5000 + '{"k":9}]}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, raw string")
    out = df.select("i", J.search_key(F.col("raw"), "k").alias("o"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got, found = {r.i: r.o for r in out.collect()}, 0
    for i, text in enumerate(docs):
        try:
            node = json.loads(text) if text is not None else None
        except ValueError:
            node = None
        want = _dfs_first(node, "k")[1] if isinstance(node, dict) else None
        assert (json.loads(got[i]) if got[i] is not None else None) == want, text
        found += want is not None
    assert found > 100


def test_find_key_first_against_python(spark):
    docs = [{"a": {"recipeIngredient": ["nested"]}, "recipeIngredient": ["top"]},
            {"recipeIngredient": ["top"], "b": {"recipeIngredient": ["later"]}},
            {"l": [1, [{"recipeIngredient": ["in list of list"]}], {"recipeIngredient": ["dict in list"]}]},
            {"x": 1}, {"recipeIngredient": "string"}]
    texts = [json.dumps(d) for d in docs]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    v = F.from_json("raw", "struct<recipeIngredient: variant>")["recipeIngredient"]
    raw = F.from_json("raw", "struct<recipeIngredient: string>")["recipeIngredient"]
    got = [r.k for r in df.select(J.find_key_first(F.col("raw"), "recipeIngredient", v, raw).alias("k")).collect()]
    want = []
    for d in docs:
        found, val = _dfs_first(d, "recipeIngredient")
        want.append(json.dumps(val) if found else None)
    assert [json.loads(g) if g else None for g in got] == [json.loads(w) if w else None for w in want]


def test_extract_ldjson_rows(spark):
    df = pages(spark, [(1, "u", script("[]") + script(json.dumps(RECIPE)))])
    rows = L.extract_ldjson(df).collect()
    assert [(r.pos, r.kind, r.is_candidate) for r in rows] == [(0, "list", False), (1, "object", True)]


def _reasons(spark, html):
    df = pages(spark, [(k, "https://www.bonappetit.com/r/" + str(k), v) for k, v in html.items()])
    return {r.page_id: (r.recipe.title if r.recipe else None, r.reason) for r in X.extract(df).collect()}


def test_malformed_graph_and_exact_script_type(spark):
    graph = json.dumps({"@graph": [RECIPE]})
    rec = json.dumps(RECIPE)
    def typed(attributes):
        return f"<script {attributes}>{rec}</script>"

    got = _reasons(spark, {1: script(graph + " trailing junk"), 2: script(graph), 3: typed('type="application/ld+json; charset=utf-8"'),
                           4: typed('data-type="application/ld+json"'), 5: typed("async type=application/ld+json"),
                           6: typed('id="x" TYPE = \'application/ld+json\' data-x'), 7: typed('type="application/LD+JSON"')})
    assert got[1][0] is None and got[3][0] is None and got[4][0] is None and got[7][0] is None
    assert got[2] == got[5] == got[6] == ("Soup", None)


def test_null_ingredients_and_missing_instructions(spark):
    no_steps = {k: v for k, v in RECIPE.items() if k != "recipeInstructions"}
    got = _reasons(spark, {1: script(json.dumps(dict(RECIPE, recipeIngredient=None))), 2: script(json.dumps(no_steps)),
                           3: script(json.dumps(dict(no_steps, extra={"itemListElement": [{"text": "x"}]}))),
                           4: script(json.dumps(dict(RECIPE, recipeInstructions=[])))})
    assert got[1] == (None, "null_ingredients") and got[2] == (None, "no_instructions")
    assert got[3] == got[4] == ("Soup", None)


def test_yields_compare_by_type(spark):
    values = {1: [8, 12], 2: ["8", "12"], 3: [2.5, 10.25], 4: 6, 5: []}
    df = pages(spark, [(k, "https://www.bonappetit.com/r", script(json.dumps(dict(RECIPE, recipeYield=v)))) for k, v in values.items()])
    got = {r.page_id: r.recipe["yield"] for r in X.extract(df).collect()}
    assert got == {1: "12", 2: "8", 3: "10.25", 4: "6", 5: ""}


def test_huge_durations_do_not_end_the_job(spark):
    rec = dict(RECIPE, totalTime="PT200000000000S", cookTime="P9999999999999999D", prepTime="PT2147483647M")
    both = dict(RECIPE, totalTime="", cookTime="PT2147483647M", prepTime="PT2147483647M")
    assert _reasons(spark, {1: script(json.dumps(rec)), 2: script(json.dumps(both))}) == {1: ("Soup", None), 2: ("Soup", None)}


def test_rows_do_not_depend_on_the_split(spark, tmp_path):
    """One file, many files and packed files of the same pages give equal rows."""
    from mise.sources import fixtures as FX
    source = FX.ldjson_pages(spark, "/root/testdata/sf0.001")
    seen = []
    for i, n in enumerate((1, 8, 3)):
        path = str(tmp_path / f"p{i}")
        source.repartition(n).write.parquet(path)
        out = X.run_extraction(spark.read.parquet(path), str(tmp_path / f"out{i}"))
        seen.append(sorted(map(str, out.collect())))
    assert seen[0] == seen[1] == seen[2]


def test_scripts_are_parsed_once_a_page(spark):
    """No filter below the generator takes the scripts apart again; pages whose only mention is no script have no rows."""
    rows = L.extract_ldjson(pages(spark, [(1, "https://a.example/1", script(json.dumps(RECIPE)) * 2), (2, "https://a.example/2", L.LDJSON_MARKER),
                                          (3, "https://a.example/3", None), (4, "https://a.example/4", "")]))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted((r.page_id, r.pos, r.kind, r.is_candidate) for r in rows.collect()) == [(1, 0, "object", True), (1, 1, "object", True)]
