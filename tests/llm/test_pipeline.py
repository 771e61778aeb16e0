import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as spec
import corpus_pipeline
from tablechange.llm.registry import table


def test_stages_and_columns(spark, sf):
    assert len(corpus_pipeline.STAGES) == 5
    docs = table(spark, sf, "documents")
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == before, name
        assert out.schema.simpleString() == docs.schema.simpleString()


def test_near_copies_and_copies_leave_one(spark, make, sf):
    docs = make([(1, "One two three four five"), (2, "one TWO three four five"), (3, "quite another text of words"), (4, None), (5, ""), (None, "odd one out")])
    kept = corpus_pipeline.drop_copies(spark, docs, sf)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([2, 3, 5, None], key=repr)
    near = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert sorted((r["doc_id"] for r in near.collect()), key=repr) == sorted([1, 3, 4, None], key=repr)


def test_one_row_of_each_group_stays(spark, make, sf):
    a, b = "one two three four five six", "another text of seven words with more"
    rows = [(1, a)] * 3 + [(2, a), (None, a), (None, b), (None, b), (None, b.upper()), (3, "x"), (3, "y z"), (3, "x"), (None, None), (None, "")]
    want = [(3, "x"), (3, "y z"), (None, ""), (None, b)]
    for stage, owner in ((corpus_pipeline.drop_copies, 2), (corpus_pipeline.drop_near_copies, 1)):
        got = [(r["doc_id"], (r["text"] or "").lower()) for r in stage(spark, make(rows), sf).collect()]
        assert sorted(got, key=repr) == sorted([*want, (owner, a)], key=repr), stage


def test_run_against_plain_steps(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = spec.queries()["pipeline"](spark, sf).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    folded = {"".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]]) for r in rows}
    assert len(folded) == len({r["doc_id"] for r in rows})


def test_empty_input(spark, make, sf):
    docs = make([])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
