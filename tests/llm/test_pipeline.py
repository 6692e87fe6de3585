"""The pipeline's stages, one after the other, against what each may drop."""

from __future__ import annotations

import corpus_pipeline
from odd import passage

from millrace.llm.scratch import stored
from millrace.sources import table

SMALL = "/root/testdata/sf0.001"


def test_stages_drop_what_they_should_and_keep_the_rest(spark):
    item = table(spark, SMALL, "benchmark").first()["text"]
    clean = [(k, passage(k, 80)) for k in range(1000, 1030)]
    rows = [
        *clean,
        (2000, "you idiot moron trash scum " + passage(1, 60)),
        (2001, passage(1000, 80)),  # copy
        (2002, passage(1001, 79) + " end"),  # near copy
        (2003, passage(7, 60) + " " + " ".join(passage(1002, 80).split()[10:70]) + " " + passage(8, 60)),
        (2004, passage(9, 50) + " " + item),
        (2005, None), (2006, ""),
    ]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r for r in docs.collect()}
    ids = {i for i, _ in rows}
    assert set(kept["toxicity"]) == ids - {2000}
    assert set(kept["near_duplicates"]) == ids - {2000, 2001, 2002}
    assert set(kept["substring_dedup"]) == ids - {2000, 2001, 2002}
    cut = kept["substring_dedup"][2003]
    assert len(cut.text.split()) == 120 and cut.n_chars == len(cut.text)
    assert set(kept["decontamination"]) == ids - {2000, 2001, 2002, 2004}
    assert all(kept["decontamination"][i].text == t for i, t in clean)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {p.doc_id for p in pieces} == set(kept["decontamination"])


def test_stages_are_the_dealt_ones():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]


def rows_of(docs):
    return sorted(map(tuple, docs.collect()), key=repr)


def test_stages_on_empty_repeated_and_clashing_tables(spark):
    """Extra columns are carried whatever their names, repeated rows share a verdict, no rows give none."""
    item = table(spark, SMALL, "benchmark").first()["text"]
    leak, copy = 100_020, 100_030  # no labelled ids
    rows = [(100_000 + k, passage(k, 70), "en", "s", 0) for k in range(1, 9)]
    rows += [rows[0], rows[0], (leak, item, "de", None, None), (leak, item, "de", None, None), (None,) * 5]
    rows += [(copy, passage(3, 70), "en", "s", 0), (100_031, "", "fr", "s", 0)]
    names = ("score", "given", "toxic", "features", "block", "digest", "node", "label", "ids", "h1", "kept", "fold")
    docs = spark.createDataFrame(
        [(*r, *(f"{n}{r[0]}" for n in names)) for r in rows],
        ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{n} string" for n in names)]),
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), SMALL)
        assert empty.columns == docs.columns and empty.isEmpty()
        found = stored(stage(spark, docs, SMALL), "test-stage")
        assert found.columns == docs.columns
        wanted = rows_of(docs)
        if name == "near_duplicates":
            wanted = [r for r in wanted if r[0] != copy]
        if name == "decontamination":
            wanted = [r for r in wanted if r[0] != leak]
        if name == "substring_dedup":
            # Of the later copy no word is left.
            wanted = [r for r in wanted if r[0] != copy]
        assert rows_of(found) == wanted, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.limit(0), SMALL).isEmpty()
    assert last(spark, docs, SMALL).select("doc_id").distinct().count() == len({r[0] for r in rows})


def test_run_matches_its_stages(spark):
    """run() on the small tables gives the rows of the stages, one after the other."""
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), f"test-{name}")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows_of(corpus_pipeline.run(spark, SMALL).select(columns)) == rows_of(docs.select(columns))
