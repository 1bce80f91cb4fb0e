import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mise.llm import fill_in_middle as M
from mise.llm import queries as Q

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute(text, doc_id):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def many_texts():
    rnd = random.Random(3)
    out = ["", "\n", "a", "a\n", "\n\n", "<P>x", "a<", "<S", "a\n🙂b\r\n\x00c", "x" * 65535 + "\n", "x" * 65536 + "\n", "ab\n" * 70000,
           "a\n" * 50000 + "x" * 70000, "\n" * 4096 + "b\n" * 9000] + ["\n" * k for k in (65534, 65535, 65536, 65537, 131072)]
    out += ["".join(rnd.choice(["a", "\n", "é", "🙂", "bb"]) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    return out + ["".join(rnd.choice(["a", "\n", "\n", "é", "🙂"]) for _ in range(rnd.randint(60000, 140000))) for _ in range(6)]


def test_boundaries_select_like_a_list_in_all_three_containers():
    kinds = set()
    for text in many_texts():
        bounds = M.line_boundaries(text)
        want = [0] + [m.end() for m in UNIT.finditer(text)]
        assert bounds.size == len(want)
        assert [bounds.select(k) for k in range(0, len(want), max(1, len(want) // 5000))] == want[::max(1, len(want) // 5000)]
        kinds |= {type(c) for c in bounds.containers}
    assert kinds == {M.ArrayContainer, M.BitmapContainer, M.RunContainer}
    with pytest.raises(IndexError):
        M.line_boundaries("a").select(2)


def test_transform_and_back():
    for i, text in enumerate(many_texts()):
        got = M.transformed(text, M.digest_of(i))
        assert got == brute(text, i)
        assert M.restored(got[4], got[1]) == text


def test_odd_rows(spark, make_docs, odd_rows):
    df = make_docs(odd_rows, clash=("n", "form", "output", "fim_source__"))
    out = M.transform(df).collect()
    want = sorted(((i, *brute(t, i)) for i, t in odd_rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=str) == want
    assert all(r.restored_sha256 == sha(r.text or "") and r.output_sha256 == sha(r.output) for r in out)
    assert M.transform(make_docs([])).count() == 0


def test_bytes_that_are_no_text_come_back(spark):
    df = spark.sql("select 1L as doc_id, cast(x'61ff0a62fe0ac3' as string) as text")
    row = M.transform(df).select(F.sha2(F.col("text"), 256).alias("own"), "restored_sha256", "n").first()
    assert row.own == row.restored_sha256 and row.n == 3


def test_whole_table_equals_brute_force(spark, documents):
    out = Q.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    want = {r.doc_id: (brute(r.text, r.doc_id), sha(r.text or "")) for r in documents.collect()}
    assert len(out) == len(want)
    for r in out:
        (n, form, prefix, middle, output), own = want[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), own)
