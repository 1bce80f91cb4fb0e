from pyspark.sql import functions as F

from mise.operators import golden as G
from mise.operators import render as RD
from mise.sources import manifest as M

LONG = ("Stir the well-known mixture " * 6).strip()
RECIPES = [
    {"url": "https://www.food.com/r/1", "title": "Tea", "description": "Hot " * 30, "yield": "2",
     "preptime": "5 minutes", "cooktime": "", "totaltime": "1 hour ", "author": "",
     "ingredient_groups": [{"title": "", "ingredients": ["leaves", ""]}],
     "direction_groups": [{"group": "x", "directions": ["Boil " * 40, "", LONG, "A" * 90 + " tail"]}],
     "notes": None},
    {"url": "", "title": "Cake ((v2))", "description": "", "yield": None, "preptime": None, "cooktime": None,
     "totaltime": None, "author": "Me",
     "ingredient_groups": [{"title": "Base", "ingredients": ["flour"]}, {"title": "Top", "ingredients": ["sugar"]}],
     "direction_groups": [{"group": "", "directions": ["Mix"]}, {"group": "", "directions": ["Bake", "Cool"]}],
     "notes": ["A ***bold*** note " * 8, "second"]},
    {"url": "https://x.example/3", "title": "Soup", "description": "d", "yield": "", "preptime": "",
     "cooktime": "", "totaltime": "TBD", "author": "", "ingredient_groups": [], "direction_groups": [],
     "notes": ["only one note"]},
    {"url": "u", "title": "", "description": "", "yield": "", "preptime": "", "cooktime": "", "totaltime": "",
     "author": "", "ingredient_groups": [], "direction_groups": [], "notes": None},
]


TEA = """%s

%s

%s

{desc1}
{desc2}

%s

%s leaves
%s 

%s

1. Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil
   Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil
   Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil Boil
3. Stir the well-known mixture Stir the well-known mixture Stir the well-
   known mixture Stir the well-known mixture Stir the well-known mixture
   Stir the well-known mixture
4. {long}
   {rest} tail
""".replace("{desc1}", " ".join(["Hot"] * 19)).replace("{desc2}", " ".join(["Hot"] * 11)).replace("{long}", "A" * 72).replace("{rest}", "A" * 18)
CAKE = """%s

Source: Me


%s

%s

%s flour

%s

%s sugar

%s

1. Mix
1. Bake
2. Cool

%s

%s A bold note A bold note A bold note A bold note A bold note A bold note A
  bold note A bold note

%s second

"""
SOUP = """%s

%s

%s

d

%s


%s


%s

only one note

"""
DOCUMENTS = {
    (0, "md"): TEA % ("## Tea", "|-----------------|---------------|----------|\n| Prep: 5 minutes | Total: 1 hour | Yield: 2 |\n"
                      "|-----------------|---------------|----------|", "Source: [www.food.com](https://www.food.com/r/1)",
                      "### Ingredients", "*", "*", "### Directions"),
    (0, "rst"): TEA % ("Tea\n===", "+-----------------+---------------+----------+\n| Prep: 5 minutes | Total: 1 hour | Yield: 2 |\n"
                       "+-----------------+---------------+----------+", "Source: `www.food.com <https://www.food.com/r/1>`__",
                       "Ingredients\n-----------", "-", "-", "Directions\n----------"),
    (1, "md"): CAKE % ("## Cake (v2)", "### Ingredients", "#### Base", "*", "#### Top", "*", "### Directions", "### Notes", "*", "*"),
    (1, "rst"): CAKE % ("Cake (v2)\n=========", "Ingredients\n-----------", "Base\n^^^^", "-", "Top\n^^^", "-", "Directions\n----------",
                        "Notes\n-----", "-", "-"),
    (2, "md"): SOUP % ("## Soup", "|------------|\n| Total: TBD |\n|------------|", "Source: [x.example](https://x.example/3)",
                       "### Ingredients", "### Directions", "### Notes"),
    (2, "rst"): SOUP % ("Soup\n====", "+------------+\n| Total: TBD |\n+------------+", "Source: `x.example <https://x.example/3>`__",
                        "Ingredients\n-----------", "Directions\n----------", "Notes\n-----"),
}


def _df(spark):
    rows = [(i, r) for i, r in enumerate(RECIPES)]
    st = ("struct<url: string, title: string, description: string, yield: string, preptime: string, "
          "cooktime: string, totaltime: string, author: string, "
          "ingredient_groups: array<struct<title: string, ingredients: array<string>>>, "
          "direction_groups: array<struct<group: string, directions: array<string>>>, notes: array<string>>")
    return spark.createDataFrame(rows, f"page_id bigint, recipe {st}")


def test_render_matches_documents_written_by_hand(spark):
    docs = RD.render_docs(_df(spark), ["md", "rst", "json"]).collect()
    by = {(d.page_id, d.format): d for d in docs}
    assert (3, "md") not in by  # empty title: no document
    for i, rec in enumerate(RECIPES[:3]):
        for fmt in ["md", "rst"]:
            assert by[(i, fmt)].body == DOCUMENTS[i, fmt], (i, fmt)
    assert by[(0, "md")].filename == "Tea.md" and by[(1, "rst")].filename == "Cakev2.rst"


def test_collision_last_wins(spark):
    df = spark.createDataFrame([(1, "a.md", "x"), (5, "a.md", "y"), (3, "b.md", "z")], "page_id bigint, filename string, body string")
    df = df.withColumn("format", F.lit("md"))
    got = {r.filename: (r.page_id, r.body, r.n_candidates) for r in RD.filename_collision(df).collect()}
    assert got == {"a.md": (5, "y", 2), "b.md": (3, "z", 1)}


def test_manifest_parse(spark, tmp_path):
    text = "# header\n\nhttp://a/x|a.rst # note\n   http://b/y#frag|b.md\nhttp://c/z|c.json\nnobar\n"
    p = tmp_path / "m.tests"
    p.write_text(text)
    rows = M.scan_manifest(spark, str(p)).orderBy("line_no").collect()
    assert [(r.url, r.ref_file, r.format) for r in rows] == [
        ("http://a/x", "a.rst", "rst"), ("http://b/y", "http://b/y", None), ("http://c/z", "c.json", "json"),
        ("nobar", "nobar", None)]


def test_golden_statuses(spark):
    tests = spark.createDataFrame([(1, "u1", "a.rst"), (2, "u2", "b.rst"), (3, "u3", "c.rst"), (4, "u4", "a.rst"),
                                   (5, "u5", "d.rst")], "line_no bigint, url string, ref_file string")
    actual = spark.createDataFrame([(1, "x\n\ny  \n"), (2, "x\nz"), (3, "new"), (4, "x\ny"), (5, None)],
                                   "line_no bigint, body string")
    ref = spark.createDataFrame([("a.rst", "x\ny\n"), ("b.rst", "x\ny"), ("c.rst", ""), ("d.rst", "q")],
                                "ref_file string, body string")
    v = G.golden_diff(tests, actual, ref)
    got = {r.line_no: r.status for r in v.collect()}
    assert got == {1: "PASS", 2: "FAIL", 3: "MISSING", 4: "PASS", 5: "ERROR"}
    assert [(r.ref_file, r.body) for r in G.golden_missing(v, actual).collect()] == [("c.rst", "new")]
    assert {r.status: r.n_tests for r in G.status_counts(v).collect()} == {"PASS": 2, "FAIL": 1, "MISSING": 1, "ERROR": 1}


def test_one_new_reference_per_missing_file(spark):
    tests = spark.createDataFrame([(k, "u", "new.rst") for k in range(5)], "line_no bigint, url string, ref_file string")
    actual = spark.createDataFrame([(0, None), (1, "first"), (2, "second"), (3, "third"), (4, None)], "line_no bigint, body string")
    none = spark.createDataFrame([], "ref_file string, body string")
    v = G.golden_diff(tests, actual, none)
    assert [(r.ref_file, r.body) for r in G.golden_missing(v, actual).collect()] == [("new.rst", "first")]
    assert "act_body" not in v.columns


def test_collision_without_positions_or_hot_names(spark):
    df = spark.createDataFrame([(None, "a.md", "md", "x"), (1, "b.md", "md", "y"), (None, "b.md", "md", "z")],
                               "page_id bigint, filename string, format string, body string")
    got = {r.filename: (r.page_id, r.body, r.n_candidates) for r in RD.filename_collision(df).collect()}
    assert got == {"a.md": (None, "x", 1), "b.md": (1, "y", 2)}
    # Bodies are only aggregated after the join that leaves the winners.
    plan = RD.filename_collision(df)._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in plan.split("\n") if "Aggregate" in line]
    assert len(aggregates) == 2 and not any("body" in line for line in aggregates[1:])


def test_collision_leaves_one_row_per_name(spark):
    rows = [(None, "a.md", "md", "x"), (None, "a.md", "md", "x"), (None, "a.md", "md", "w"), (7, "b.md", "md", "y"), (7, "b.md", "md", "y"),
            (7, "b.md", "rst", "z"), (2, "b.md", "md", "q"), (1, "c.md", None, None), (0, None, "md", "n")]
    df = spark.createDataFrame(rows, "page_id bigint, filename string, format string, body string")
    got = RD.filename_collision(df).collect()
    assert sorted((str(r.filename), r.page_id, r.n_candidates) for r in got) == [("None", 0, 1), ("a.md", None, 3), ("b.md", 7, 4), ("c.md", 1, 1)]
    assert sorted(got, key=str) == sorted(RD.filename_collision(df.repartition(5)).collect(), key=str)


def test_appended_manifest_lines_stay_apart(spark):
    def lines(numbers):
        return spark.createDataFrame([(n, "u", "r", "md") for n in numbers], "line_no bigint, url string, ref_file string, format string")
    loaded = lines([n << 33 for n in range(200)])
    both = M.manifest_append(loaded, lines([n << 33 for n in range(200)]))
    assert both.select("line_no").distinct().count() == 400
    assert M.manifest_append(lines([]), lines([3])).count() == M.manifest_append(lines([3]), lines([])).count() == 1


def test_wrap_of_unicode_line_ends(spark):
    import textwrap
    texts = ["one\u2028two " * 20, "a\x85b " * 40, "word \u2029 word " * 15, "x \u00a0 y " * 20, "plain words only " * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.b for r in df.select(RD.wrap_groups(F.array(F.array("t")), "numbered").alias("b")).collect()]
    for t, b in zip(texts, got):
        assert b == "".join(x + "\n" for x in textwrap.wrap(t, 75, initial_indent="1. ", subsequent_indent="   "))


def test_explicit_output_name(spark):
    docs = RD.render_docs(_df(spark), ["md", "rst"], outfile="all.md")
    assert {r.filename for r in docs.select("filename").distinct().collect()} == {"all.md", "all.md.rst"}
    assert {r.filename: (r.page_id, r.n_candidates) for r in RD.filename_collision(docs).collect()} == {"all.md": (2, 3), "all.md.rst": (2, 3)}


def test_golden_gives_one_verdict_whatever_repeats(spark):
    tests = spark.createDataFrame([(1, "u1", "a.md", "md"), (2, "u1", "b.md", "md"), (3, "u2", "a.md", "md")],
                                  "line_no bigint, url string, ref_file string, format string")
    docs = spark.createDataFrame([(1, "u1", "md", "old"), (5, "u1", "md", "new"), (None, "u1", "md", "unset"), (2, "u2", "md", "two"), (2, "u2", "md", "two")],
                                 "pos bigint, url string, format string, body string")
    refs = spark.createDataFrame([(1, "a.md", "old"), (2, "a.md", "new"), (1, "b.md", "new  \n")], "pos bigint, ref_file string, body string")
    got = sorted((r.line_no, r.status) for r in G.golden_run(tests, docs, refs, "pos").collect())
    assert got == [(1, "PASS"), (2, "PASS"), (3, "FAIL")]
    assert sorted(tuple(r) for r in G.produced(tests, docs, "pos").collect()) == [(1, "new"), (2, "new"), (3, "two")]
    # Tests run in line order; the last one that writes a file leaves it.
    assert sorted(tuple(r) for r in G.golden_reset(tests, docs, "pos").collect()) == [("a.md", "two"), ("b.md", "new")]
    actual = spark.createDataFrame([(1, "old"), (1, "new"), (3, None)], "line_no bigint, body string")
    assert G.golden_diff(tests, actual, refs, "pos").count() == 3


def test_golden_join_keeps_what_stands_alone(spark):
    tests = spark.createDataFrame([(1, "u1", "a.md"), (2, "u2", "a.md"), (3, "u3", "new.md"), (4, "u4", None)], "line_no bigint, url string, ref_file string")
    actual = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "line_no bigint, body string")
    refs = spark.createDataFrame([("a.md", "x "), ("orphan.md", "o"), ("empty.md", ""), ("orphan.md", "o")], "ref_file string, body string")
    got = sorted((str(r.ref_file), r.line_no or 0, r.side, r.has_output, r.has_reference, r.same) for r in G.golden_join(tests, actual, refs).collect())
    assert got == [("None", 4, "test", False, False, False), ("a.md", 1, "both", True, True, True), ("a.md", 2, "both", True, True, False),
                   ("empty.md", 0, "reference", False, False, False), ("new.md", 3, "test", True, False, False),
                   ("orphan.md", 0, "reference", False, True, False)]
    assert G.golden_join(tests.limit(0), actual.limit(0), refs.limit(0)).count() == 0


def test_reset_and_write_back(spark, tmp_path):
    tests = spark.createDataFrame([(1, "u1", "a.md", "md"), (2, "u2", "a.md", "md"), (3, "u3", "b.md", "md"), (4, "u1", "c.rst", "rst")],
                                  "line_no bigint, url string, ref_file string, format string")
    docs = spark.createDataFrame([("u2", "md", "two"), ("u1", "rst", "r"), ("u9", "md", "no test")], "url string, format string, body string")
    assert sorted((r.ref_file, r.body) for r in G.golden_reset(tests, docs).collect()) == [("a.md", "two"), ("c.rst", "r")]
    back = M.scan_manifest(spark, M.write_manifest(tests, str(tmp_path / "m"))).orderBy("line_no").collect()
    assert [(r.url, r.ref_file, r.format) for r in back] == [(r.url, r.ref_file, r.format) for r in tests.orderBy("line_no").collect()]
    v = {r.line_no: r.status for r in G.golden_run(tests, docs, spark.createDataFrame([("a.md", "two"), ("b.md", "x")], "ref_file string, body string")).collect()}
    assert v == {1: "ERROR", 2: "PASS", 3: "ERROR", 4: "MISSING"}


def test_run_documents_are_rendered_without_a_shuffle(spark, monkeypatch):
    """The golden run renders in one narrow pass: every recipe under its address, in all formats, old and new."""
    from mise.plans import catalog

    rows = spark.sql("SELECT id AS page_id, concat('https://a.example/', id) AS url, CASE WHEN id = 3 THEN 'no_ldjson' END AS reason FROM range(4)")
    from mise.operators.recipes import RECIPE_DDL
    blank = spark.createDataFrame([({"title": "Soup", "url": "https://a.example/"},)], f"recipe struct<{RECIPE_DDL}>")
    monkeypatch.setattr(catalog, "_f2_extracted", lambda s, d: rows.crossJoin(F.broadcast(blank)))
    monkeypatch.setattr(catalog.FX, "ldjson_pages", lambda s, d: rows.select("page_id", "url"))
    docs = catalog._run_documents(spark, "unused")
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the one of this test's own rows
    got = docs.select("page_id", "url", "format", "captured", F.col("body").startswith("as it was ").alias("old")).collect()
    assert sorted(tuple(r) for r in got) == sorted(
        (i, f"https://a.example/{i}", f, c, c == 0) for i in range(3) for f in ("json", "md", "rst") for c in (0, 1))
