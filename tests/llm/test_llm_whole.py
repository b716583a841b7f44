"""Training-data operators keep what is theirs to keep."""

import random

import numpy as np

import corpus_pipeline
from corpusloom.llm import licenses, suffix_dedup

PASSAGE = " ".join(random.Random(5).choice(["stone", "river", "\u00fcber", "cloud", "tr\u00e4ge"]) + str(i) for i in range(60))


def test_cut_characters():
    data = "a\u00e9\u20ac\U0001f600z".encode()
    for b in range(len(data)):
        for e in range(b + 1, len(data) + 1):
            left, right = data[:b].decode(errors="ignore"), data[e:].decode(errors="ignore")
            assert suffix_dedup.kept_characters(data, np.array([b]), np.array([e])) == (left + right).encode()


def test_pipeline_keeps_markers_of_the_text(spark, sf):
    # the last byte of both characters before the passage is the same, so the cut goes through them
    rows = [(1, "a\ufffd\u00e9" + PASSAGE + "b\ufffd", "en", "s", 0), (2, "c\u0169" + PASSAGE + "d", "en", "s", 0), (3, "\ufffd", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, docs, sf).collect()}
    assert got == {1: "a\ufffdb\ufffd", 2: "cd", 3: "\ufffd"}


def test_exact_copies_go_through_the_expansion(spark, monkeypatch):
    docs = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE)], "doc_id long, text string")
    assert suffix_dedup.repeated_spans(docs).count() == 1

    def nothing(length):
        def run(batches):
            for _ in batches:
                pass
            yield from ()

        return run

    monkeypatch.setattr(suffix_dedup, "_expand", nothing)
    assert suffix_dedup.repeated_spans(docs).count() == 0


def test_license_near_copy_between_windows(spark):
    text = "w4849 w3755 Redistribution and changed in source and binary forms, with or without modification, are permitted provided that the following conditions are met: w2135 w2667 w3354 w1168 w4963 w2305 w315 w3682 w2549 w447 w142 w835"
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.license, round(r.containment, 6)) for r in got] == [("bsd-redistribution", round(14 / 17, 6))]
