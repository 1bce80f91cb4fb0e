import corpus_pipeline as CP
from mise.llm import bench_decontam, quality_rules, secret_scans, sentencepiece_codec, simhash_neardup

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    assert [n for n, _ in CP.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {d for d, r in rows.items() if not any(rule(quality_rules.Text(r.text.encode())) for rule in quality_rules.RULES.values())}
    seen = docs
    for (name, stage), check in zip(CP.STAGES, range(5)):
        seen = stage(spark, seen, SF)
        got = {r.doc_id: r for r in seen.collect()}
        if check == 0:
            assert set(got) == kept
        elif check == 1:
            fps = {d: simhash_neardup.fingerprint(rows[d].text.encode()) for d in kept}
            lows = [d for d in kept if not any(e < d and bin(fps[e] ^ fps[d]).count("1") <= 2 for e in kept)]
            assert set(lows) >= set(got) and set(got) <= kept
            kept = set(got)
        elif check == 2:
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            leaks = {r.doc_id for r in bench_decontam.matches(docs, items).collect()}
            kept -= leaks
            assert set(got) == kept and leaks
        elif check == 3:
            assert set(got) == kept and not any(secret_scans.scan(r.text) for r in got.values())
            assert {d for d, r in got.items() if secret_scans.MASK in r.text} == {d for d in got if secret_scans.scan(rows[d].text)}
        if check < 4:
            assert seen.columns == columns
    assert {"ids", "n_tokens"} <= set(seen.columns)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model())
    assert all(r.ids == codec.encode([r.text])[0][0].tolist() for r in got.values())


def test_run_equals_the_stages(spark):
    out = CP.run(spark, SF)
    assert out.count() == len({r.doc_id for r in out.select("doc_id").collect()}) > 0


def test_odd_rows_pass_every_stage(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=("fp", "kept", "matches", "secrets", "ids"))
    for name, stage in CP.STAGES:
        out = stage(spark, docs, SF)
        if name != "encoding":
            assert out.columns == docs.columns
        out.count()
        assert stage(spark, docs.where("false"), SF).count() == 0
