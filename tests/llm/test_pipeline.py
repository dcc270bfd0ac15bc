import pytest

import corpus_pipeline
from smoothspan.llm.lexicon_automaton import ToxicScorer, fit_toxicity

from . import brute


def test_pipeline_against_brute_force(spark, sf_dir):
    """All stages but the learned score are recomputed in plain Python; the score comes from the fitted model."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scorer = ToxicScorer(model)
    scores = scorer.scores(scorer.features(pa.array(list(rows.values()))))
    rows = {i: t for (i, t), s in zip(rows.items(), scores, strict=True) if s < 0.5}
    gone = brute.duplicate_lines(sorted(rows.items()))
    cut = {i: brute.without(t, {n for d, n in gone if d == i}) for i, t in rows.items()}
    rows = {i: t for i, t in cut.items() if t.strip() or t == rows[i]}
    near = brute.components({i: brute.shingles(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if near[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute.contained(rows.items(), items)}
    from tokenizers import Tokenizer

    from smoothspan.llm.registry import vocabulary_path

    t = Tokenizer.from_file(vocabulary_path())
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in rows.items() if i not in leaked}
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(spark, odd, sf_dir, k):

    docs = odd.select("doc_id", "text", "lang").selectExpr("*", "lang AS source", "cast(length(text) AS long) AS n_chars")
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    assert out.columns == docs.columns and out.count() <= docs.count()
    none = corpus_pipeline.STAGES[k][1](spark, docs.limit(0), sf_dir)
    assert none.count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_with_clashing_columns(spark, odd, empty, sf_dir, k):
    """Nulls, empty and long texts, ties and repeated rows, with extra columns named like inner ones."""
    docs = odd.selectExpr("*", "lang AS source", "cast(length(text) AS long) AS n_chars")
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    rows = out.collect()
    nulls = [r for r in rows if r["doc_id"] is None]
    if k == 4:
        assert len(rows) == docs.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5)} == {0}
    else:
        assert out.columns == docs.columns and {4, 5, 7} <= {r["doc_id"] for r in rows} and len(nulls) == 2
        assert len([r for r in rows if r["doc_id"] == 8]) == 2 and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    none = empty.selectExpr("*", "lang AS source", "cast(length(text) AS long) AS n_chars", "node AS low", "node AS doc")
    assert corpus_pipeline.STAGES[k][1](spark, none, sf_dir).count() == 0
