import pytest

from mise.llm import license_scans as L


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def licenses(model, docs):
    return {r.doc_id: [(x.paragraph, x.family, x.confirmed) for x in r.licenses] for r in L.scan(docs, model).collect()}


def test_every_template_is_found_in_a_text(model, make_docs):
    rows = [(i, f"plain words stand here\n{t}\nand more of them") for i, t in enumerate(t for ts in L.TEMPLATES.values() for t in ts)]
    family = [f for f, ts in L.TEMPLATES.items() for _ in ts]
    got = licenses(model, make_docs(rows))
    assert sum(got[i] == [(1, family[i], True)] for i in range(len(rows))) >= 0.95 * len(rows)


def test_sql_scores_equal_the_model(model, make_docs):
    """Expressions against the numpy statement of the same model."""
    import numpy as np
    texts = ["Licensed under the MIT License.", "licence of the third kind", "GNU public BSD apache", "All rights reserved", "CC BY-ND 4.0 or CC BY-SA"]
    rows = L.scan(make_docs(list(enumerate(texts))), model).select("doc_id", "licenses").collect()
    for r in rows:
        p = model.probs(texts[r.doc_id])
        best = model.classes[int(p.argmax())]
        if best == L.NONE:
            assert r.licenses == []
        else:
            assert r.licenses[0].family in (best, L.UNKNOWN) and np.isclose(r.licenses[0].probability, p.max(), atol=1e-5)


def test_held_out_wordings(model, make_docs):
    rows = [(1, "The code is released under the terms of the MIT License"), (2, "Source is licensed under Apache License Version 2.0"),
            (3, "licensed under the GNU General Public License version 3 or later"), (4, "text available under CC BY-NC 4.0")]
    got = licenses(model, make_docs(rows))
    assert [got[i][0][1] for i in (1, 2, 3, 4)] == ["mit", "apache-2.0", "gpl", "cc-by-nc"]


def test_planted_lines_and_nothing_else(model, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = licenses(model, docs)
    marks = {"mit": "MIT License", "apache-2.0": "Apache License, V", "gpl": "GNU General Public", "cc-by-nc": "CC BY-NC"}
    for r in docs.collect():
        assert {f for _, f, _ in got[r.doc_id]} == {f for f, m in marks.items() if m in r.text}


def test_a_text_without_vocabulary_words_is_none_by_construction(model):
    assert model.bias[-1] > max(model.bias[:-1])
    assert all(w in model.weights for g in model.weights for w in g.split() if w in L.CUES)


def test_unknown_class(model, make_docs):
    got = licenses(model, make_docs([(1, "license"), (2, "the license of a thing")]))
    assert all(f in (L.UNKNOWN,) or not c for i in got for _, f, c in got[i])
    assert 0 < model.threshold < 1


def test_odd_rows(model, make_docs, odd_rows):
    twice = "Released under the MIT License."
    docs = make_docs([*odd_rows, (30, f"{twice}\n\n{twice}")], clash=("licenses", "family", "__grams"))
    got = L.scan(docs, model)
    assert got.count() == len(odd_rows) + 1
    assert [x.paragraph for x in got.where("doc_id = 30").first().licenses] == [0, 2]
    assert L.scan(make_docs([]), model).count() == 0
    assert L.scan(make_docs([(1, twice)]), L.fit(make_docs([]))).first().licenses[0].family == "mit"


def test_an_ordinary_word_of_a_licence_keeps_its_weight(spark, make_docs):
    """German text, full of "mit", in the sample; a paragraph with a cue word that is no licence."""
    german = [(i, f"Sie kam mit dem Zug {i}.\nEr fuhr mit ihr nach Hause und sprach mit dem Kind.\nHer driving license {i} was lost.") for i in range(300)]
    model = L.fit(make_docs(german))
    assert "mit" in model.weights and "the mit license" in model.weights
    got = licenses(model, make_docs([(1, "Released under the MIT License."), (2, "Released under the Foo License."), (3, "Er kam mit der Version zu ihr."),
                                     (4, "Her driving license 7 was lost."), (5, "Licensed under the MIT license")]))
    assert [f for _, f, _ in got[1]] == [f for _, f, _ in got[5]] == ["mit"] and got[3] == got[4] == []
    assert [(f, c) for _, f, c in got[2]] == [(L.UNKNOWN, False)]


WRAPPED = {
    "bsd": ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are", "met:"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining", "a copy of this software and associated documentation files (the \"Software\"),", "to deal in it"],
    "gpl": ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
            "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file except in compliance with the License."],
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; "])
def test_wrapped_notices_are_confirmed(model, make_docs, mark):
    rows = [(i, "\n".join(["words before", "", *[mark + line for line in lines], "", "words after it"])) for i, lines in enumerate(WRAPPED.values())]
    found = {r.doc_id: r.licenses for r in L.scan(make_docs(rows), model).collect()}
    for i, (family, lines) in enumerate(WRAPPED.items()):
        assert {x.family for x in found[i] if x.confirmed} == {family}
        first = next(x for x in found[i] if x.confirmed)
        assert 2 <= first.paragraph < 2 + len(lines) and first.n_lines <= len(lines)


def test_lines_that_are_notices_themselves_stay_apart(model, make_docs):
    got = L.scan(make_docs([(1, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nplain\nReleased under the BSD 3-Clause License.")]), model).first().licenses
    assert [(x.paragraph, x.n_lines, x.family, x.confirmed) for x in got] == [(0, 1, "mit", True), (1, 1, "cc-by-nc", True), (3, 1, "bsd", True)]


def test_many_license_lines_take_linear_time(model, make_docs):
    import time
    text = "\n".join(["Released under the MIT License.", "some words between them"] * 3000)
    start = time.time()
    assert len(L.scan(make_docs([(1, text)]), model).first().licenses) == 3000
    assert time.time() - start < 60
