"""Recipe -> documents (Markdown, reStructuredText, JSON), one row per (recipe, format).

Rendering is a projection over the recipe row: headers, info and source
lines are string expressions; list blocks are ``transform`` + ``array_join``
over the nested arrays.  Lines are wrapped at 75 columns by an in-row fold
(``functions.wrapping``), so no part of a Markdown or reStructuredText document leaves the
JVM; JSON text is written in an Arrow UDF (``functions.jsontext``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hof as H
from ..functions.jsontext import pretty_json
from ..functions.text import clean_text, output_filename, register_sql_functions, title_filename
from ..functions.urls import url_domain
from ..session import bound_batches

# --- fixed values -----------------------------------------------------------
RST_LEVEL_CHARS = ["=", "-", "^"]
BULLET = {"md": "*", "rst": "-"}
FORMATS = ["json", "md", "rst"]
DEFAULT_FORMATS = ["rst"]
# ---------------------------------------------------------------------------


def _s(c: Column) -> Column:
    """Renderer's view of a scalar field: cleaned text, '' when unset."""
    return F.coalesce(clean_text(c), F.lit(""))


def header(text: Column, fmt: str, level: int) -> Column:
    if fmt == "md":
        return F.concat(F.lit("#" * (level + 1) + " "), text, F.lit("\n\n"))
    under = F.repeat(F.lit(RST_LEVEL_CHARS[level - 1]), F.char_length(text))
    return F.concat(text, F.lit("\n"), under, F.lit("\n\n"))


def info_line(prep: Column, total: Column, yld: Column, fmt: str) -> Column:
    part = lambda label, v: F.when(v != "", F.concat(F.lit(label), v, F.lit(" | "))).otherwise(F.lit(""))
    info = F.rtrim(F.concat(F.lit("| "), part("Prep: ", prep), part("Total: ", total), part("Yield: ", yld)))
    divider = F.regexp_replace(info, r"[^|]", "-")
    if fmt == "rst":
        divider = F.translate(divider, "|", "+")
    return F.when(info != "|", F.concat(divider, F.lit("\n"), info, F.lit("\n"), divider, F.lit("\n\n"))) \
        .otherwise(F.lit(""))


def source_line(url: Column, author: Column, fmt: str) -> Column:
    who = F.when(author == "", url_domain(url)).otherwise(author)
    if fmt == "md":
        linked = F.concat(F.lit("Source: ["), who, F.lit("]("), url, F.lit(")\n\n"))
    else:
        linked = F.concat(F.lit("Source: `"), who, F.lit(" <"), url, F.lit(">`__\n\n"))
    return (F.when(url == "", F.when(author != "", F.concat(F.lit("Source: "), author, F.lit("\n\n")))
                   .otherwise(F.lit("")))
            .otherwise(linked))


# ------------------------------------------------------------------ wrapping
def wrap_groups(groups: Column, mode: str, bullet: str = "", blank_after: bool = False) -> Column:
    """Wrapped lines of a list of item lists, each line followed by a newline.

    ``numbered``: prefix ``n. `` restarting in every group (directions);
    ``plain``: no prefix; ``bullet``: ``<bullet> `` prefix.  ``blank_after``
    adds an empty line after every item (notes).  Lines after an item's first are
    indented by the length of its prefix.
    """
    register_sql_functions()
    wrapped = F.call_function("mise_wrap_groups", groups, F.lit(mode), F.lit(bullet), F.lit(blank_after))
    return F.coalesce(wrapped, F.lit(""))


# ----------------------------------------------------------------- documents
def _ingredient_block(groups: Column, fmt: str) -> Column:
    bullet = BULLET[fmt]

    def group(g, gi):
        t = _s(g["title"])
        head = F.when(t != "", F.concat(F.when(gi > 0, F.lit("\n")).otherwise(F.lit("")), header(t, fmt, 3))) \
            .otherwise(F.lit(""))
        items = F.array_join(H.transform(F.coalesce(g["ingredients"], F.array().cast("array<string>")),
                                         lambda it: F.concat(F.lit(bullet + " "), F.coalesce(it, F.lit("")), F.lit("\n"))), "")
        return F.concat(head, items)

    return F.coalesce(F.array_join(H.transform(groups, group), ""), F.lit(""))


def add_documents_staging(recipes: DataFrame, recipe: str = "recipe") -> DataFrame:
    """Stage the cleaned scalar fields and wrapped blocks shared by md and rst."""
    r = F.col(recipe)
    empty = F.array().cast("array<string>")
    dir_groups = H.transform(
        F.coalesce(r["direction_groups"], F.array().cast("array<struct<group:string,directions:array<string>>>")),
        lambda g: F.coalesce(g["directions"], empty))
    staged = recipes.withColumns({
        "_title": _s(r["title"]), "_yield": _s(r["yield"]), "_prep": _s(r["preptime"]),
        "_total": _s(r["totaltime"]), "_url": _s(r["url"]), "_author": _s(r["author"]),
        "_desc": _s(r["description"]),
        "_notes": H.transform(r["notes"], lambda n: F.replace(F.coalesce(n, F.lit("")), F.lit("***"), F.lit(""))),
    })
    several = F.size("_notes") > 1
    return staged.withColumns({
        "_desc_block": wrap_groups(F.array(F.array(F.col("_desc"))), "plain"),
        "_dir_block": wrap_groups(dir_groups, "numbered"),
        "_notes_one": wrap_groups(F.array(F.when(~several, F.col("_notes"))), "plain", blank_after=True),
        "_notes_md": wrap_groups(F.array(F.when(several, F.col("_notes"))), "bullet", BULLET["md"], blank_after=True),
        "_notes_rst": wrap_groups(F.array(F.when(several, F.col("_notes"))), "bullet", BULLET["rst"], blank_after=True),
    })


def render_body(fmt: str, recipe: str = "recipe") -> Column:
    """Document text of the staged recipe row in ``md`` or ``rst``."""
    r = F.col(recipe)
    notes = F.col("_notes")
    # One note: wrapped as is; more than one: a bulleted list (the evident intent).
    notes_items = F.when(F.size(notes) > 1, F.col("_notes_md") if fmt == "md" else F.col("_notes_rst")) \
        .otherwise(F.col("_notes_one"))
    notes_part = F.when(notes.isNull(), F.lit("")).otherwise(
        F.concat(F.lit("\n"), header(F.lit("Notes"), fmt, 2), notes_items))
    return F.concat(
        header(F.col("_title"), fmt, 1),
        info_line(F.col("_prep"), F.col("_total"), F.col("_yield"), fmt),
        source_line(F.col("_url"), F.col("_author"), fmt),
        F.col("_desc_block"), F.lit("\n"),
        header(F.lit("Ingredients"), fmt, 2), _ingredient_block(r["ingredient_groups"], fmt),
        F.lit("\n"), header(F.lit("Directions"), fmt, 2), F.col("_dir_block"),
        notes_part)


def render_docs(recipes: DataFrame, formats: list[str] | None = None, key: str = "page_id",
                recipe: str = "recipe", outfile: str | None = None) -> DataFrame:
    """``(key, format, filename, body)``: one document per recipe and format.

    No format given -> rst; recipes with an empty title produce no document.  JSON is
    indented by four and in ASCII, unset fields left out.
    ``outfile`` names every document (the last one written stays, see
    ``filename_collision``); without it the title does.
    Narrow: fan-out is a generator over a literal array, no shuffle.
    """
    fmts = formats or DEFAULT_FORMATS
    if "json" in fmts:
        bound_batches(recipes.sparkSession)
    staged = add_documents_staging(recipes.filter(_s(F.col(recipe)["title"]) != ""), recipe)
    body = F.lit(None).cast("string")
    for f in fmts:
        b = pretty_json(recipe, recipes.schema[recipe].dataType) if f == "json" else render_body(f, recipe)
        body = F.when(F.col("format") == f, b).otherwise(body)
    out = (staged.withColumn("format", F.explode(F.array(*[F.lit(f) for f in fmts])))
           .withColumn("body", body)
           .withColumn("filename", title_filename(F.col("_title"), F.col("format")) if outfile is None
                       else output_filename(F.lit(outfile), F.col("format"))))
    return out.select(key, "format", "filename", "body")


def filename_collision(docs: DataFrame, order_col: str = "page_id") -> DataFrame:
    """Files are written in input order and overwritten, so the *last* document
    per file name wins: exactly one row for each name.

    Unset positions come first.  Of documents at one position the one with the greatest digest
    of format and body wins, and equal documents are one.  Last position and count are a
    hash aggregate without bodies: a file name shared by a third of all rows leaves one
    small row per task.  Bodies at a last position are then fetched and, where a name
    has several there, reduced within each task before they meet.
    """
    last = (docs.groupBy("filename").agg(F.max(order_col).alias("_last"), F.count(F.lit(1)).alias("n_candidates"))
            .withColumnRenamed("filename", "_name"))
    held = docs.select("filename", order_col, "format", "body", F.xxhash64("format", "body").alias("_digest"))
    same = F.col("filename").eqNullSafe(F.col("_name")) & F.col(order_col).eqNullSafe(F.col("_last"))
    won = held.join(last, same).groupBy("filename").agg(F.max(F.struct("_digest", "format", "body", order_col, "n_candidates")).alias("_won"))
    return won.select("filename", *[F.col("_won").getField(c).alias(c) for c in (order_col, "format", "body", "n_candidates")])


def sink_documents(docs: DataFrame, path: str) -> str:
    """Write rendered documents as one table partitioned by format.

    A corpus-scale stand-in for one file per recipe: each format is a folder
    of parquet files holding ``(key, filename, body)``; readers prune by
    format through the partition column.
    """
    docs.write.mode("overwrite").partitionBy("format").parquet(path)
    return path
