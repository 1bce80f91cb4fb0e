"""Fields of site pages read in the UDF against the expressions that define them."""
import json
import random

from pyspark.sql import functions as F

from mise.functions import text as T
from mise.operators import sitefields as SF
from mise.operators import sites as S
from mise.plans import extract as X

BITS = ["a", "Salt", "1", " ", "  ", "\n", "\t", "\r", " ", " ", " ", "\u0085", "\u001c", "\u000b", "<b>", "</p>", "<", ">", "&nbsp;", "&amp;", "&#39;",
        "&#8217;", "&frac12;", "&", "½", "⅓", "Â", "’", "((", "))", "(", ")", " // ", "//", "/", "é", "日本", "\U0001f35e", '"', "\\", "***", "​", " // "]


def words(rnd, most=7):
    return "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, most)))


def odd(rnd, regular):
    """Mostly the value itself; now and then what is not expected there."""
    return regular if rnd.random() < 0.99 else rnd.choice([None, 5, 1.50, True, [], {}, ["x", 1], {"name": "n", "fields": 3}, "", [None], 10 ** 25])


def some(rnd, pairs):
    """An object with most of the fields, in any order."""
    keys = [k for k in pairs if rnd.random() < 0.96]
    rnd.shuffle(keys)
    return {k: odd(rnd, pairs[k]) for k in keys}


def next_data(rnd):
    def item():
        return some(rnd, {"fields": some(rnd, {"qty": words(rnd, 2), "preText": words(rnd, 2), "postText": words(rnd, 2),
                                               "ingredient": some(rnd, {"fields": some(rnd, {"title": words(rnd)})})})})
    doc = some(rnd, {"title": words(rnd) or "t", "yields": words(rnd), "recipeTimeNote": words(rnd), "headnote": words(rnd), "other": {"k": [1, "🍞"]},
                     "metaData": some(rnd, {"fields": some(rnd, {"description": words(rnd), "source": words(rnd)})}),
                     "ingredientGroups": [some(rnd, {"fields": some(rnd, {"title": words(rnd), "recipeIngredientItems": [item() for _ in range(rnd.randint(0, 3))]})})
                                          for _ in range(rnd.randint(0, 3))],
                     "instructions": [some(rnd, {"fields": some(rnd, {"content": words(rnd)})}) for _ in range(rnd.randint(0, 3))]})
    body = json.dumps({"props": {"initialState": {"content": {"documents": odd(rnd, {"d1": odd(rnd, doc), "d2": {"title": "other"}})}}}}, ensure_ascii=rnd.random() < 0.4)
    body = rnd.choice([body] * 30 + [body + " tail", body[:-1], " " + body + "\n", body.replace('"title"', '"yields"'), body.replace("{", "{\n", 2), body.replace('"d1"', "'d1'"),
                                    body.replace('"k": [1', '"k": [NaN'), body.replace("d83c", "d83d\\ud83d"), body.replace('"d1"', '"d\t1"'), body.replace('"k"', "[" * 1100 + "]" * 1100)])
    tag = rnd.choice(['<script id="__NEXT_DATA__">'] * 15 + ["<SCRIPT type='x' ID=__next_data__ async>", "<script data-id='__NEXT_DATA__'>", "<script é id='__NEXT_DATA__'>",
                                                            "<script éid='__NEXT_DATA__'>", "<script xid=__NEXT_DATA__>", "<script>var x = '__NEXT_DATA__'</script><script id=\"__NEXT_DATA__\" >"])
    return "<html>" + words(rnd) + tag + body + rnd.choice(["</script>"] * 15 + ["</SCRIPT>", "</script >", ""]) + "<script>1</script>"


def store(rnd):
    author = rnd.choice(["Ann ", [{"name": "Bo "}], {"name": "<i>C</i>"}, [], None, "", [{"x": 1}], ["Dee"], [{"name": 3}], {"name": None}, 7])
    content = some(rnd, {"hed": words(rnd) or "h", "dek": words(rnd), "servingSizeInfo": some(rnd, {"servingSizeDescription": words(rnd)}), "formattedPrepTime": rnd.choice(["PT5M", " PT1H", "x", ""]),
                         "formattedCookTime": rnd.choice(["PT5M", "PT90M", "<b>PT2H</b>"]), "author": author,
                         "ingredientGroups": [some(rnd, {"hed": "x", "ingredients": [some(rnd, {"description": words(rnd)}) for _ in range(rnd.randint(0, 3))]}) for _ in range(rnd.randint(0, 3))],
                         "preparationGroups": [some(rnd, {"steps": [some(rnd, {"description": words(rnd)}) for _ in range(rnd.randint(0, 3))]}) for _ in range(rnd.randint(0, 3))]})
    fix = rnd.choice(["", '"v":{"email":{"regExp":/^\\S+}$/,"password":{"regExp":/^.{6}$/,"messages":{}}},'])
    line = ('root.__INITIAL_STATE__.store = {' + fix + '"content":' + json.dumps(odd(rnd, content), ensure_ascii=rnd.random() < 0.6) + rnd.choice(["}"] * 20 + ["", "}}", "} x}", ',"content":{}}']))
    line = rnd.choice([line] * 15 + ["no braces root.__INITIAL_STATE__.store", line.replace('"hed"', '"dek"'), "// root.__INITIAL_STATE__.store {} " + line + "\u0085x = 1"])
    tag = rnd.choice(["<script>"] * 10 + ["<SCRIPT a='b'>", "<script", "<script><script>"])
    return words(rnd) + tag + "\nvar a;\n" + line + rnd.choice([";"] * 4 + ["; tail {}"]) + "\n" + rnd.choice(["</script>"] * 15 + ["</Script>", ""]) + "<script>x</script>"


def test_pages_read_in_the_udf_are_what_the_expressions_make(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [(i, f"https://www.cookscountry.com/{i}" if i % 2 else f"https://www.epicurious.com/{i}", next_data(rnd) if i % 2 else store(rnd)) for i in range(1600)]
    rows += [(-1, "https://www.epicurious.com/x", None), (-2, "https://www.cookscountry.com/x", None), (-3, "https://www.cookscountry.com/x", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(8)
    got = {r.page_id: (r.recipe, r.reason) for r in X.extract(pages).collect()}
    read = [bool(S.page_fields(h.encode(), S.KIND_NEXT_DATA if i % 2 else S.KIND_STORE)) for i, _, h in rows if h]
    assert 400 < sum(read) < 1400  # both ways are taken
    none = F.lit(None).cast(S.site_fields.returnType)
    monkeypatch.setattr(S, "site_fields", lambda html, kind: none)
    want = {r.page_id: (r.recipe, r.reason) for r in X.extract(pages).collect()}
    assert len(got) == len(rows) and got == want


def test_text_rules_are_the_expressions(spark):
    rnd = random.Random(5)
    texts = sorted({words(rnd, 12) for _ in range(3000)})
    x = F.col("x")
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(
        x, T.clean_text(x).alias("c"), T.strip_tags(x).alias("s"), T.strip_tags(x, True).alias("n"), T.strip_tags(T.clean_text(x), True).alias("t"))
    for r in df.collect():
        assert (r.c, r.s, r.n, r.t) == (SF.clean_text(r.x), SF.strip_tags(r.x), SF.strip_tags(r.x, True), SF.cleaned_twice(r.x, True)), r.x


def test_plainly_written_tags_are_read_as_the_parser_reads_them(monkeypatch):
    rnd = random.Random(3)
    bits = ["<p>", "</p>", '<div class="sqs-block-content">', "</div>", '<ul a="1">', "<ul data-rte-list='default'>", "<li>", '<li class="x" id="y">', "</li>", "</ul>", "<br>", "<br/>",
            '<div class="sqs-layout row">', '<meta content="PT5M">', '<a href="x&amp;y" href="z">', "<script>", "</script>", "<title>", "</title>", "<textarea>", "<TITLE >", "</P >",
            "text", "&amp;", "&", "<", "<!-- c -->", "<!doctype html>", '<h1 class="entry-title">', "</h1>", "</", "<p", '<div property="description">', '<i x="1" x="2">', "—"]
    head = '<title>T</title><div class="sqs-block"><div class="sqs-block-content"><p>a</p><p>b</p><ul><li>x</li>'
    pages = [rnd.choice(["", head]) + "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    got = [S.dom_page(h, k) for h in pages for k in "ab"]
    for name in ("parse_starttag", "parse_endtag", "updatepos"):
        monkeypatch.delattr(S._Collector, name)
    assert got == [S.dom_page(h, k) for h in pages for k in "ab"]
    assert any(x.get("ok") for x in got)


def test_pages_go_to_python_in_small_batches_for_the_extraction_only(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "extract", lambda pages, key: seen.append(spark.conf.get(X.BATCH_BYTES_KEY)) or pages)
    pages = spark.range(3).selectExpr("id as page_id")
    before = spark.conf.get(X.BATCH_BYTES_KEY)
    assert X.run_extraction(pages, str(tmp_path / "a")).count() == 3
    assert seen == [str(X.BATCH_BYTES)] and spark.conf.get(X.BATCH_BYTES_KEY) == before
    assert all(".zstd." in f.name for f in (tmp_path / "a").glob("part-*"))
    spark.conf.set(X.BATCH_BYTES_KEY, "1000000")
    try:
        X.run_extraction(pages, str(tmp_path / "b"))
        assert spark.conf.get(X.BATCH_BYTES_KEY) == "1000000"
    finally:
        spark.conf.unset(X.BATCH_BYTES_KEY)
