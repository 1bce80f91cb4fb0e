"""Recipe-page corpora derived by Spark from the driver's tables.

The driver's ``pages`` hold no recipes, so the recipe routes are exercised on
pages that Spark *derives* row-by-row from other tables (one source row -> one
page, no grouping), so their size grows with the scale factor:

* ``ldjson_pages``  (F2) from ``part``: one JSON-LD page per part, in nine
  script layouts (object, list, @graph, malformed, list-then-object, ...).
* ``site_pages``    (F7) from ``documents``: each document on the next-data, the
  inline-store and the two DOM layouts, with its whole text in every longer field.
* ``chain_pages``   from ``part``: a JSON recipe, a microdata recipe, both, neither, or a
  broken JSON recipe beside a microdata one, on a JSON-LD or an inline-store host.
* ``remapped_pages`` (F1) ``pages`` with the host swapped for a known publisher
  domain by ``page_id % 13``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hof as H
from ..functions.urls import PUBLISHERS
from ..session import ensure_checkpoint_dir
from .tables import TABLE_CODEC, read_table

FIXTURE_VERSION = "v6"
FIXTURE_TABLES = {"ldjson_pages": ["part"], "site_pages": ["documents"], "chain_pages": ["part"]}
# Files per derived corpus: a crawl arrives as many files, so scans get
# parallel splits (a single small parquet file is one row group, one task).
FIXTURE_FILES_PER_CORE = 2
# Bytes of the source table's files whose pages one file takes, where that makes more files.
FIXTURE_BYTES_PER_FILE = 8 << 20

# --- fixed values (fixture layout) ------------------------------------------
LDJSON_DOMAINS = ["www.bonappetit.com", "www.foodnetwork.com", "cooking.nytimes.com",
                  "www.food.com", "www.thechunkychef.com", "www.allrecipes.com",
                  "recipes.example.org"]
NEXT_DATA_DOMAINS = ["www.americastestkitchen.com", "www.cookscountry.com", "www.cooksillustrated.com"]
REMAP_DOMAINS = [d for d, _ in PUBLISHERS] + ["unknown.example.net"]
# ---------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def listing_digest(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the files under ``paths`` (name, size, modification time): a corpus
    derived from them is used again only while they are the same."""
    jvm = spark.sparkContext._jvm
    seen = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        seen += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(p))
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:24]


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write a derived corpus once as parquet under the shared checkpoint folder
    and scan it from there, exactly as captured pages would be scanned.

    Generated page text is a very large expression; scanning it from parquet
    keeps the extraction plan the production plan (scan -> project).
    """
    tag = listing_digest(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in FIXTURE_TABLES[name]])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/mise-fixtures/{FIXTURE_VERSION}/{tag}/{name}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        build(spark, sf_dir).write.mode("overwrite").option("compression", TABLE_CODEC).parquet(path)
    return spark.read.parquet(path)


def _dealt(rows: DataFrame, table: str, sf_dir: str) -> DataFrame:
    """The source rows dealt evenly to the tasks that make pages of them.

    A table may come in one split, and its rows are a small part of their pages, so rows
    are dealt out before the pages are made and pages are never shuffled.  There are a few tasks
    for each core, more of them where the table's files are large.
    """
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{table}.parquet")
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return rows.repartition(max(1, spark.sparkContext.defaultParallelism * FIXTURE_FILES_PER_CORE, size // FIXTURE_BYTES_PER_FILE))


def jq(c: Column) -> Column:
    """JSON string literal (quoted, escaped) of a string column."""
    return F.get(H.transform(F.array(F.to_json(F.array(c))), lambda t: F.substring(t, F.lit(2), F.char_length(t) - 2)), 0)


def _pick(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def ldjson_recipe_object(k: Column, name: Column, brand: Column, ptype: Column, size: Column,
                         with_ingredients: bool = True) -> Column:
    """JSON text of the fixture Recipe object for one part."""
    s = size.cast("string")
    headline = (F.when(k % 11 == 3, _cat('"headline":', jq(_cat("<em>", F.upper(name), "</em>")), ","))
                .when(k % 11 == 4, F.lit('"headline":null,'))
                .otherwise(F.lit("")))
    yld = (F.when(k % 3 == 0, _cat('"recipeYield":', jq(_cat("<b>", s, "</b> servings")), ","))
           .when(k % 12 == 1, _cat('"recipeYield":[', s, ",", (size + 4).cast("string"), "],"))
           .when(k % 3 == 1, _cat('"recipeYield":[', jq(s), ",", jq(_cat(s, " servings")), "],"))
           .otherwise(_cat('"recipeYield":', s, ",")))
    times = (F.when(k % 5 == 0, _cat('"totalTime":"PT', s, 'M","cookTime":"PT', (size % 7).cast("string"), 'M",'))
             .when(k % 5 == 1, _cat('"prepTime":"PT', s, 'M","cookTime":"PT1H', s, 'M",'))
             .when(k % 5 == 2, _cat('"totalTime":"P0DT', (size % 3).cast("string"), "H", s, 'M",'))
             .when(k % 5 == 3, _cat('"cookTime":"PT', (size * 60).cast("string"), 'S",'))
             .otherwise(F.lit("")))
    author = (F.when(k % 4 == 0, _cat('"author":{"@type":"Person","name":', jq(_cat("Chef ", brand)), "},"))
              .when(k % 4 == 1, _cat('"author":[{"@type":"Person","name":', jq(brand), '},{"name":"Other"}],'))
              .when(k % 4 == 2, _cat('"author":', jq(_cat("<span>", brand, "</span>")), ","))
              .otherwise(F.lit("")))
    ingredients = F.when(k % 13 == 6, F.lit('"recipeIngredient":null,')).otherwise(_cat('"recipeIngredient":[', jq(_cat("<b>", brand, "</b>")), ",",
                       jq(_cat(ptype, " &frac12;")), ",", jq(_cat("((", s, " g)) of ", name)), "],"))
    steps = (F.when(k % 6 == 0, _cat('"recipeInstructions":[{"@type":"HowToStep","text":',
                                     jq(_cat("Mix the ", name, ".")),
                                     '},{"@type":"HowToStep","text":', jq(_cat("Bake ", s, " minutes.")), "}]"))
             .when(k % 6 == 1, F.lit('"recipeInstructions":"Combine all and serve."'))
             .when(k % 6 == 2, _cat('"recipeInstructions":[{"@type":"HowToSection","name":"Main",'
                                    '"itemListElement":[{"@type":"HowToStep","text":', jq(_cat("Prepare ", name)),
                                    '},{"@type":"HowToStep","text":"Rest"}]},{"@type":"HowToSection",'
                                    '"name":"Extra","itemListElement":[{"@type":"HowToStep","text":"Garnish"}]}]'))
             .when(k % 6 == 3, _cat('"recipeInstructions":[', jq(_cat("Chop the ", name, ".")), ',"Serve."]'))
             .when(k % 6 == 4, F.lit('"recipeInstructions":[{"@type":"HowToStep","name":"no text"}]'))
             .otherwise(F.lit('"tool":"oven"')))
    return _cat('{"@context":"https://schema.org","@type":"Recipe",', headline,
                '"name":', jq(_cat("  ", name, "  ")), ",",
                '"description":', jq(_cat("<p>", ptype, " &amp; ", brand, " &frac12; cup</p>")), ",",
                yld, times, author, ingredients if with_ingredients else F.lit(""), steps, "}")


def _script(k: Column, body: Column) -> Column:
    open_tag = F.when(k % 2 == 0, F.lit('<script type="application/ld+json">')) \
                .otherwise(F.lit("<script id='ld' type='application/ld+json' data-x=\"1\">"))
    return _cat(open_tag, "\n    ", body, "\n</script>")


def ldjson_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 corpus (materialised once per scale factor)."""
    return materialized(spark, sf_dir, "ldjson_pages", build_ldjson_pages)


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 corpus (materialised once per scale factor)."""
    return materialized(spark, sf_dir, "site_pages", build_site_pages)


def build_ldjson_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one JSON-LD recipe page per ``part`` row, ``page_id = p_partkey``."""
    p = _dealt(read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "part", sf_dir)
    k, name = F.col("p_partkey"), F.col("p_name")
    rec = ldjson_recipe_object(k, name, F.col("p_brand"), F.col("p_type"), F.col("p_size"))
    rec_bad = ldjson_recipe_object(k, name, F.col("p_brand"), F.col("p_type"), F.col("p_size"),
                                   with_ingredients=False)
    website = F.lit('{"@context":"https://schema.org","@type":"WebSite","name":"Site"}')
    webpage = _cat('{"@type":"WebPage","name":', jq(name), "}")
    layout = k % 9
    scripts = (F.when(layout == 0, _script(k, rec))
               .when(layout == 1, _cat(_script(k, website), _script(k, rec)))
               .when(layout == 2, _script(k, _cat('[{"name":"no type"},', website, ",", rec, "]")))
               .when(layout == 3, _script(k, _cat('{"@context":"https://schema.org","@graph":[', webpage, ",", rec, "]}")))
               .when(layout == 4, _cat(_script(k, F.lit('{"@type": "Recipe", broken')), _script(k, rec)))
               .when(layout == 5, _cat(_script(k, _cat("[", website, "]")), _script(k, rec)))
               .when(layout == 6, _cat(_script(k, rec), _script(k, _cat("[", website, "]"))))
               .when(layout == 7, F.lit(""))
               .otherwise(_script(k, rec_bad)))
    domain = _pick(k, LDJSON_DOMAINS)
    url = _cat("https://", domain, "/recipe/", k.cast("string"), "/", F.replace(name, F.lit(" "), F.lit("-")))
    html = _cat("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>", name, "</title>",
                scripts, "</head><body><h1>", name, "</h1><p>", F.col("p_type"), "</p></body></html>")
    return p.select(k.alias("page_id"), url.alias("url"), html.alias("html"))


def chain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for the fall-through between extractors (materialised once per scale factor)."""
    return materialized(spark, sf_dir, "chain_pages", build_chain_pages)


def build_chain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per ``part`` row: ``p_partkey % 5`` is 0 JSON only, 1 microdata only, 2 both,
    3 neither, 4 broken JSON beside microdata; ``p_partkey % 3 = 0`` is an inline-store page."""
    p = _dealt(read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "part", sf_dir)
    k, name, brand, ptype = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type")
    s = F.col("p_size").cast("string")
    ld = _cat('{"@type":"Recipe","name":', jq(name), ',"totalTime":"PT', s, 'M","recipeIngredient":[', jq(brand), "],",
              F.when(k % 5 == 4, F.lit('"tool":"oven"}')).otherwise(_cat('"recipeInstructions":[', jq(_cat("Mix ", name)), "]}")))
    store = _cat('{"hed":', jq(name), ',"formattedPrepTime":"PT', s, 'M","ingredientGroups":[{"ingredients":[{"description":', jq(brand),
                 '}]}],"preparationGroups":[{"steps":[{"description":', jq(_cat("Mix ", name)), "}]}]}")
    on_store = k % 3 == 0
    own = F.when(~on_store, _script(k, ld)).otherwise(_cat(
        "<script>\nroot.__INITIAL_STATE__.store = {", '"content":', store, F.when(k % 5 == 4, F.lit("")).otherwise(F.lit("}")), ";\n</script>"))
    item = _cat('<div itemscope itemtype="https://schema.org/Recipe"><h1 itemprop="name"> Micro ', html_escape(name), "\n</h1>",
                '<span itemprop="author" itemscope itemtype="https://schema.org/Person"><b itemprop="name">Cook</b></span>',
                '<time itemprop="totalTime" datetime="PT', s, 'M">soon</time><meta itemprop="recipeYield" content="', s, ' servings">',
                "<ul><li itemprop=\"recipeIngredient\">", html_escape(ptype), "</li><li itemprop='recipeIngredient'><b>", html_escape(brand), "</b> &amp; salt</li></ul>",
                '<div itemprop="recipeInstructions"><p>Chop <i>', html_escape(name), "</i></p><p>Bake<br>Serve &lt;hot&gt;</p></div></div>")
    head = F.when(k % 5 == 1, F.lit("")).when(k % 5 == 3, F.lit("")).otherwise(own)
    body = F.when((k % 5 == 0) | (k % 5 == 3), F.lit("")).otherwise(item)
    host = F.when(on_store, F.lit("www.epicurious.com")).otherwise(F.lit("recipes.example.org"))
    return p.select(k.alias("page_id"), _cat("https://", host, "/r/", k.cast("string")).alias("url"),
                    _cat("<!DOCTYPE html><html><head><title>", html_escape(name), "</title>", head, "</head><body>", body, "</body></html>").alias("html"))


def remapped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with the host replaced by the ``page_id % 13``-th known domain (or an unknown one)."""
    pages = read_table(spark, sf_dir, "pages")
    dom = _pick(F.col("page_id"), REMAP_DOMAINS)
    url = F.regexp_replace(F.col("url"), "^([a-z]+://)[^/?#]*", "")
    return pages.select("page_id", _cat("https://", dom, url).alias("url"), "html")


def html_escape(c: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                        F.lit(">"), F.lit("&gt;"))
    # To ask for a character is several times cheaper than to replace it.
    return F.when(F.contains(c, F.lit("&")) | F.contains(c, F.lit("<")) | F.contains(c, F.lit(">")), escaped).otherwise(c)


def build_site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """four pages per ``documents`` row, one of each layout (``page_id = doc_id * 4 + variant``).

    Variants: 0 next-data (three hosts), 1 inline store, 2 DOM layout A, 3 DOM layout B
    (odd documents without the row wrapper).  Title = the first line; description, notes, ingredients
    (one for each line) and directions (likewise) hold the whole text.
    """
    docs = (_dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "documents", sf_dir)
            .withColumn("variant", F.explode(F.array(*[F.lit(v) for v in range(4)]))))
    d, variant, text = F.col("doc_id"), F.col("variant"), F.col("text")
    lines = F.split(text, "\n")
    title = F.get(lines, 0)

    # next-data document (nested struct -> JSON keeps field order)
    item = lambda w, i: F.struct(F.struct(
        (i + 1).cast("string").alias("qty"),
        F.when(i % 2 == 0, F.lit("cup")).otherwise(F.lit("")).alias("preText"),
        F.when(i % 3 == 0, F.lit(", chopped")).otherwise(F.lit("")).alias("postText"),
        F.struct(F.struct(w.alias("title")).alias("fields")).alias("ingredient")).alias("fields"))
    group_main = F.struct(F.struct(F.lit("For the base").alias("title"),
                                   H.transform(lines, item).alias("recipeIngredientItems")).alias("fields"))
    group_finish = F.struct(F.struct(F.lit("To finish").alias("title"), F.array(F.struct(F.struct(
        F.lit("1").alias("qty"), F.lit("pinch").alias("preText"), F.lit("").alias("postText"),
        F.struct(F.struct(F.lit("salt").alias("title")).alias("fields")).alias("ingredient")).alias("fields")))
        .alias("recipeIngredientItems")).alias("fields"))
    nd_doc = F.to_json(F.struct(
        title.alias("title"),
        F.concat((d % 8 + 1).cast("string"), F.lit(" servings")).alias("yields"),
        F.when(d % 3 == 0, F.lit("")).otherwise(F.concat((d % 90 + 5).cast("string"), F.lit(" minutes")))
         .alias("recipeTimeNote"),
        F.concat(F.lit("<p>*** "), text, F.lit("</p>")).alias("headnote"),
        F.struct(F.struct(text.alias("description"),
                          F.when(d % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("Test Kitchen "), (d % 5).cast("string")))
                          .alias("source")).alias("fields")).alias("metaData"),
        F.when(d % 3 == 0, F.array(group_main, group_finish)).otherwise(F.array(group_main)).alias("ingredientGroups"),
        H.transform(lines, lambda l: F.struct(F.struct(l.alias("content")).alias("fields"))).alias("instructions")))
    nd_html = _cat("<!DOCTYPE html><html><head><title>", html_escape(title), "</title></head><body><div id=\"app\"></div>",
                   '<script id="__NEXT_DATA__" type="application/json">{"props":{"initialState":{"content":'
                   '{"documents":{"doc-', d.cast("string"), '":', nd_doc, ',"related":{"title":"x"}}}}},"page":"/r"}',
                   "</script></body></html>")

    # inline store
    author = (F.when(d % 3 == 0, _cat('[{"name":', jq(_cat("Cook ", (d % 7).cast("string"))), "}]"))
              .when(d % 3 == 1, _cat('{"name":', jq(_cat("Cook ", (d % 7).cast("string"))), "}"))
              .otherwise(F.lit('"Epicurious Staff"')))
    ingr_groups = F.to_json(F.when(d % 2 == 0, F.array(
        F.struct(F.lit("Main").alias("hed"), H.transform(lines, lambda w: F.struct(w.alias("description"))).alias("ingredients")),
        F.struct(F.lit("Sauce").alias("hed"), F.array(F.struct(F.lit("salt &amp; pepper").alias("description"))).alias("ingredients"))))
        .otherwise(F.array(F.struct(F.lit("Main").alias("hed"),
                                    H.transform(lines, lambda w: F.struct(w.alias("description"))).alias("ingredients")))))
    prep_groups = F.to_json(F.array(F.struct(F.lit("Steps").alias("hed"),
                                             H.transform(lines, lambda l: F.struct(l.alias("description"))).alias("steps"))))
    content = _cat('{"hed":', jq(title), ',"dek":', jq(_cat("<p>", text, "</p>")),
                   ',"servingSizeInfo":{"servingSizeDescription":', jq(_cat("Serves ", (d % 6 + 1).cast("string"))), "}",
                   ',"formattedPrepTime":"PT', (d % 50).cast("string"), 'M"',
                   ',"formattedCookTime":"PT', (d % 4).cast("string"), "H", (d % 60).cast("string"), 'M"',
                   ',"author":', author, ',"ingredientGroups":', ingr_groups, ',"preparationGroups":', prep_groups, "}")
    store_line = _cat('root.__INITIAL_STATE__.store = {"validation":{"email":{"regExp":/^\\S+@\\S+$/,'
                      '"password":{"regExp":/^.{6,}$/,"messages":{"ok":1}}},"content":', content, "};")
    st_html = _cat("<!DOCTYPE html><html><head><title>", html_escape(title), "</title>",
                   "<script>window.app = {};</script></head><body><script>\nvar a = 1;\n", store_line,
                   "\nvar b = 2;\n</script></body></html>")

    # DOM layout A
    li = lambda cls, arr: F.array_join(H.transform(arr, lambda x: _cat('<li class="', cls, '">', html_escape(x), "</li>")), "")
    a_html = _cat("<!DOCTYPE html><html><head><title>", html_escape(title), "</title></head><body><article>",
                  '<h1 class="entry-title">', html_escape(title), "</h1>",
                  '<div property="description"><p>', html_escape(text), "</p></div>",
                  '<div class="yield"><span>Makes\u2014', (d % 6 + 1).cast("string"), "</span></div>",
                  '<div class="cook-time"><meta content="PT', (d % 120).cast("string"), 'M"></div>',
                  "<ul>", li("ingredient", lines), "</ul><ol>", li("instruction", lines), "</ol></article></body></html>")

    # DOM layout B
    plain_li = lambda arr: F.array_join(H.transform(arr, lambda x: _cat("<li>", html_escape(x), "</li>")), "")
    paras = _cat("<p>Serves\u2014", (d % 6 + 1).cast("string"), "</p><p>", html_escape(text), "</p>")
    b_rows = _cat('<div class="sqs-layout"><div class="row"><div class="sqs-block"><div class="sqs-block-content">',
                  paras, "</div></div></div></div>",
                  '<div class="sqs-block"><div class="sqs-block-content"><ul>', plain_li(lines),
                  '<li class="note">not a step</li></ul></div></div>')
    b_flat = _cat('<div class="sqs-block"><div class="sqs-block-content">', paras, "<ul>", plain_li(lines),
                  '<li class="note">skip</li></ul></div></div>')
    b_html = _cat("<!DOCTYPE html><html><head><title>", html_escape(title), " | SAM THE COOKING GUY</title></head><body>",
                  F.when(d % 2 == 1, b_flat).otherwise(b_rows), "</body></html>")

    domain = (F.when(variant == 0, _pick(d, NEXT_DATA_DOMAINS))
              .when(variant == 1, F.lit("www.epicurious.com"))
              .when(variant == 2, F.lit("www.saveur.com"))
              .otherwise(F.lit("www.thecookingguy.com")))
    html = (F.when(variant == 0, nd_html).when(variant == 1, st_html)
            .when(variant == 2, a_html).otherwise(b_html))
    return docs.select((d * 4 + variant).alias("page_id"), _cat("https://", domain, "/recipes/", d.cast("string")).alias("url"),
                       html.alias("html"))
