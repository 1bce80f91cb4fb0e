"""Dense input positions over files and splits, and what hangs on them."""
import json
import random

import pytest

from mise.operators import render as RD
from mise.sources import manifest as M
from mise.sources import recipe_json as RJ
from mise.sources.ordinals import with_input_pos


@pytest.fixture
def small_splits(spark):
    """Many splits for small files, packed by size in an order that is not that of the files."""
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write_lines(folder, sizes, seed=1):
    rnd, want, n = random.Random(seed), [], 0
    for i, size in enumerate(sizes):
        lines = []
        for _ in range(size):
            lines.append(f"line {n} " + "x" * rnd.randint(0, 60))
            n += 1
        (folder / f"part-{i:03d}.txt").write_text("".join(line + "\n" for line in lines))
        want += lines
    return want


@pytest.mark.parametrize("sizes", [[3], [1, 0, 400, 2, 0, 57], [5] * 30, [0]])
def test_positions_follow_files_whatever_the_splits(spark, tmp_path, small_splits, sizes):
    want = write_lines(tmp_path, sizes)
    read = spark.read.text(str(tmp_path))
    got = sorted((r.input_pos, r.value) for r in with_input_pos(read).collect())
    assert got == list(enumerate(want))
    if sum(sizes) > 100:
        assert read.rdd.getNumPartitions() > len(sizes)


def test_a_filter_after_it_keeps_the_numbers(spark, tmp_path, small_splits):
    want = write_lines(tmp_path, [40, 90, 3])
    got = with_input_pos(spark.read.text(str(tmp_path)), "n", first=1).where("value like 'line 7%'")
    assert sorted((r.n, r.value) for r in got.collect()) == [(i + 1, t) for i, t in enumerate(want) if t.startswith("line 7")]


def test_a_clashing_column_is_refused(spark, tmp_path):
    write_lines(tmp_path, [1])
    with pytest.raises(ValueError):
        with_input_pos(spark.read.text(str(tmp_path)), "value")


def test_manifest_lines_are_numbered_through(spark, tmp_path, small_splits):
    (tmp_path / "a.tests").write_text("# first\n\nhttp://a|a.md\n")
    (tmp_path / "b.tests").write_text("http://b|b.md # x\n" * 30)
    (tmp_path / "c.tests").write_text("http://c|c.rst")
    rows = M.scan_manifest(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.url) for r in rows] == [(3, "http://a"), *((4 + i, "http://b") for i in range(30)), (34, "http://c")]


def test_the_last_stored_record_is_left(spark, tmp_path, small_splits):
    records = [{"title": f"Dish {i % 3}", "description": f"d{i}"} for i in range(60)]
    for k, (a, b) in enumerate([(0, 5), (5, 55), (55, 60)]):
        (tmp_path / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in records[a:b]))
    kept = RJ.scan_recipe_json(spark, str(tmp_path), pos="input_pos")
    assert [r.recipe.description for r in kept.orderBy("input_pos").collect()] == [r["description"] for r in records]
    won = RD.filename_collision(RD.render_docs(kept, ["md"], key="input_pos"), "input_pos").collect()
    assert {r.filename: (r.input_pos, r.n_candidates) for r in won} == {"Dish0.md": (57, 20), "Dish1.md": (58, 20), "Dish2.md": (59, 20)}


def test_equal_records_of_one_file_stay_apart(spark, tmp_path):
    (tmp_path / "r.json").write_text((json.dumps({"title": "Same"}) + "\n") * 4)
    assert sorted(r.page_id for r in RJ.scan_recipe_json(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]
