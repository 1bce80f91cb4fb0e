import random

from pyspark.sql import functions as F

from mise.functions import text as T
from mise.functions import urls as U


# text -> (stripped, stripped with newlines turned to spaces first), written out by hand.
EXPECTED = {
    "  <b>Hi</b>&nbsp;there ½cup ((x))) a // b\r\n\t c’s \xa0 Â ": ("Hi there 1/2cup (x)) a / b c's", "Hi there 1/2cup (x)) a / b c's"),
    " x\x1cy　": ("x y", "x y"),
    "": ("", ""),
    "a\n//\nb": ("a // b", "a / b"),
    "&frac12;&#39;&#8217;<p\n>z": ("1/2''z", "1/2''z"),
    "((((a))))": ("((a))", "((a))"),
    "&amp; &lt;kept&gt;": ("&amp; &lt;kept&gt;", "&amp; &lt;kept&gt;"),
    "⅓ cup ⅔ ¾ ¼": ("1/3 cup 2/3 3/4 1/4", "1/3 cup 2/3 3/4 1/4"),
}


def test_strip_tags_by_hand(spark):
    df = spark.createDataFrame([(s,) for s in EXPECTED], "s string")
    rows = df.select("s", T.strip_tags(F.col("s")).alias("a"), T.strip_tags(F.col("s"), True).alias("b"),
                     T.clean_text(F.col("s")).alias("c")).collect()
    for r in rows:
        assert (r.a, r.b) == EXPECTED[r.s]
        assert r.c == r.a


def test_strip_tags_random_text(spark):
    """Whatever the text: no tag, no named fraction or blank, no white-space run, nothing left to strip."""
    rnd = random.Random(7)
    alphabet = list("ab <>/&;#()\t\r\n\xa0’½¼Â") + ["&nbsp;", "&frac12;", " // ", "))", "(("]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", T.strip_tags(F.col("s")).alias("a")).collect():
        assert r.a == " ".join(r.a.split())
        assert not any(c in r.a for c in "½¼Â’\t\r\n\xa0")
        assert ("<" in r.a and ">" in r.a[r.a.index("<"):]) is False
        kept = [c for c in r.s if c in "ab"]
        assert [c for c in r.a if c in "ab"] == kept or "<" in r.s or "&" in r.s


def test_minutes_text(spark):
    ms = list(range(-5, 400))
    df = spark.createDataFrame([(m,) for m in ms], "m int")
    got = [r.t for r in df.select(T.minutes_text(F.col("m")).alias("t")).collect()]
    at = dict(zip(ms, got))
    assert all(at[m] == "TBD" for m in range(-5, 1))
    assert all(at[m] == f"{m} minutes" for m in range(2, 60)) and at[1] == "1 minute"
    assert at[60] == "1 hour "  # exact hours keep the trailing space
    assert [at[m] for m in (61, 62, 120, 121, 185, 399)] == ["1 hour 1 minute", "1 hour 2 minutes", "2 hours ", "2 hours 1 minute",
                                                             "3 hours 5 minutes", "6 hours 39 minutes"]


def test_iso_minutes(spark):
    cases = {"PT1H30M": 90, "PT45M": 45, "": 0, "P1DT2H": 1560, "PT90S": 1, "PT1H": 60, "garbage": 0,
             "PT": 0, None: 0, " PT5M ": 5, "P2D": 2880, "PT200000000000S": 0, "P9999999999999999D": 0, "PT9999999999999999999999H": 0,
             "PT2147483647M": 2147483647, "PT2147483648M": 0}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.m for r in df.select("s", T.iso_minutes(F.col("s")).alias("m")).collect()}
    assert got == cases


def test_url_domain_quirks(spark):
    urls = ["https://a.com//x", "https://a.com?x=1", "http://u:p@A.com:80/x#f", "a.com/x",
            "https://www.saveur.com/x/y  ", "https://x.org"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.d for r in df.select(U.url_domain(F.col("u")).alias("d")).collect()]
    assert got == ["x", "a.com?x=1", "u:p@A.com:80", "a.com", "www.saveur.com", "x.org"]


def test_publisher_and_route(spark):
    df = spark.createDataFrame([("https://www.epicurious.com/r/1",), ("https://www.cookscountry.com/r",),
                                ("https://www.saveur.com/a",), ("https://www.thecookingguy.com/b",),
                                ("https://blog.example/c",)], "url string")
    rows = U.route_pages(df).collect()
    assert [r.route for r in rows] == ["inline_store", "next_data", "dom_saveur", "dom_squarespace", "ldjson"]
    assert [r.publisher for r in rows] == ["Epicurious", "Cook's Country", "Saveur",
                                           "Sam the Cooking Guy (Sam Zien)", ""]
    joined = U.publisher_lookup(df).orderBy("url").collect()
    assert {r.url: r.publisher for r in joined}["https://www.saveur.com/a"] == "Saveur"


def test_filenames(spark):
    df = spark.createDataFrame([("Crème ½ brûlée: the best!",)], "t string")
    r = df.select(T.title_filename(F.col("t"), "md").alias("f"),
                  T.output_filename(F.lit("out.md"), "md").alias("g"),
                  T.output_filename(F.lit("out"), "rst").alias("h")).collect()[0]
    assert r.f == "Crème½brûléethebest.md"
    assert r.g == "out.md" and r.h == "out.rst"


def _every_rule(c):
    """The tag-stripping rules one after the other on every text, as a plain statement of them."""
    c = F.regexp_replace(F.translate(c, "’ ", "' "), "<[^>]*>", "")
    for a, b in [("&nbsp;", " "), ("&#8217;", "'"), ("&#39;", "'"), ("&frac14;", "1/4"), ("&frac12;", "1/2"), ("&frac34;", "3/4"), ("&frac13;", "1/3"),
                 ("&frac23;", "2/3"), ("¼", " 1/4"), ("½", " 1/2"), ("¾", " 3/4"), ("⅓", " 1/3"), ("⅔", " 2/3")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.translate(c, "Â\t\r", "  ")
    for a, b in [(" // ", " / "), ("))", ")"), ("((", "(")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    spaces = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return F.trim(F.regexp_replace(c, spaces, " "))


def test_strip_tags_of_long_plain_texts(spark):
    """Steps that cannot change a text are passed over: the same result, in a fraction of the time."""
    import random
    import time

    rnd = random.Random(3)
    parts = ["<b>", "<", "> ", "&nbsp;", "&#39;", "&frac23;", "&amp;", "⅓", "¼ ", "Â", "’", " ", "\t", "\r", "\n", "  ", " // ", "//",
             "))", "((", "(", "word ", "é", " ", "　", "\x85", "\x1c", "​", "日", " /"]
    odd = [""] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert df.filter(~T.strip_tags(F.col("t")).eqNullSafe(_every_rule(F.col("t")))).count() == 0

    plain = spark.createDataFrame([("chop the red onions and fry them in oil until soft " * 2000,)], "t string").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40))))

    def seconds(made):
        best = 1e9
        for _ in range(3):
            began = time.time()
            plain.select(F.sum(F.length(made(F.concat("t", F.col("n").cast("string")))))).collect()
            best = min(best, time.time() - began)
        return best

    assert seconds(T.strip_tags) < seconds(_every_rule) / 2


def test_plain_texts_are_told_from_others_in_one_run(spark):
    """The first look at a text never takes one that a rule changes, and takes the usual ones."""
    import random
    import re

    from mise.operators import sitefields as SF

    rnd = random.Random(2)
    bits = list("ab1.,;:!?'-") + [" "] * 6 + ["é", "ÿ", "½", "Â", "\u00a0", "\u0085", "\t", "\n", "(", ")", "/", "((", "//", "<", "&", "&nbsp;", "日", "’"]
    texts = sorted({"".join(rnd.choice(bits[:19] if rnd.random() < 0.7 else bits) for _ in range(rnd.randint(0, 12))) for _ in range(4000)})
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", F.col("x").rlike(T.PLAIN_RX).alias("p"), T.strip_tags(F.col("x")).alias("s"),
                                                                         T.clean_text(F.array(F.col("x"))[0]).alias("c")).collect()
    for r in got:
        assert r.s == SF.strip_tags(r.x) and r.c == SF.clean_text(r.x)
        if re.fullmatch(r"[a-z0-9.,;:!?'é-]+( [a-z0-9.,;:!?'é-]+)*", r.x):
            assert r.p, r.x
    assert sum(r.p for r in got) > 500
