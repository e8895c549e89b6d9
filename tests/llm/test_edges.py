"""Every operator and the pipeline on awkward tables: defined results, nothing lost, no crash."""

import pytest

import corpus_pipeline
from tideline.llm.common import table
from tideline.llm.queries import ORACLE_SQL, QUERIES

PER_DOCUMENT = [n for n in QUERIES if n not in ("op1_best_fit_packing", "op2_decontamination")]


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, nothing, name):
    df = QUERIES[name](spark, nothing)
    assert df.count() == 0 and len(df.columns) > 2


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, edge, name):
    folder, docs = edge
    got = QUERIES[name](spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d[0] is None, d[0] or 0) for d in docs)
    null, empty = (next(r for r in got if r.doc_id == k) for k in (0, 1))
    for column in set(null.asDict()) - {"doc_id", "held_out", "component_id"}:  # a null text is as an empty one
        assert null[column] == empty[column], column
    for r in got:
        if "score" in r and name != "op8_lm_score":
            assert 0 <= r.score <= 1


def test_defined_values(spark, edge):
    folder, _ = edge
    of = lambda name: {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}
    lang = of("op5_language_id")
    assert [lang[k].lang_pred for k in (0, 1, 2, 4, 6)] == ["und"] * 5 and lang[5].lang_pred != "und"
    tokens = of("op3_token_counts")
    assert (tokens[0].n_tokens, tokens[0].n_bytes, tokens[5].n_bytes) == (0, 0, 13) and tokens[9].over_limit
    lic = of("op4_license_scan")
    assert (lic[7].base_labels, lic[7].labels, lic[7].first_word, lic[0].labels, lic[0].first_word) == ("mit", "all-rights-reserved,mit", 0, "", None)
    rules = of("op7_quality_rules")
    assert rules[0].n_words == 0 and rules[0].base_failed and not rules[0].kept
    join = of("op9_ngram_join")
    assert join[0].n_shingles == 0 and join[0].component_id == 0 and join[3].n_shingles == 1
    copy = next(k for k in range(100, 140) if join[k].component_id != k or join[200].component_id == k)
    assert join[200].component_id == join[201].component_id == join[copy].component_id
    lm = of("op8_lm_score")
    assert lm[0].n_tokens == 1 and lm[0].score < 0 and lm[9].n_tokens == 20_001  # the end is predicted


def test_packing_edges(spark, edge):
    folder, docs = edge
    got = QUERIES["op1_best_fit_packing"](spark, folder).collect()
    assert sum(r.piece == 0 for r in got) == len(docs)
    assert {r.length for r in got if r.doc_id == 0} == {1}
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_decontamination_edges(spark, edge):
    folder, _ = edge
    got = [(r.doc_id, r.item_id, r.distance) for r in QUERIES["op2_decontamination"](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted([(12, 3, 0), (12, 4, 0), (12, None, 0)], key=repr)


def test_stages_keep_columns_and_take_effect(spark, edge, nothing):
    for folder in (edge[0], nothing):
        docs = table(spark, folder, "documents")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, folder)
            assert got.dtypes == docs.dtypes, name
            assert got.count() <= docs.count()
        near = corpus_pipeline.drop_near_copies(spark, docs, folder).collect()
        assert {200, 201}.isdisjoint(r.doc_id for r in near)
        assert len({r.doc_id for r in near if r.doc_id is not None}) == sum(r.doc_id is not None for r in near)
        assert all(r.doc_id != 12 for r in corpus_pipeline.drop_contaminated(spark, docs, folder).collect())
        assert corpus_pipeline.run(spark, folder).count() >= 0


def test_oracles_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
