"""The ledger on the pipeline's path."""

from covarium.llm import rules


def test_pipeline_filter_goes_by_the_ledger(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "too short"), (2, " ".join(f"word{i}" for i in range(30))), (3, "junk ### " * 30), (4, None)], "doc_id long, text string")
    masks = []
    real = rules.kept
    monkeypatch.setattr(rules, "kept", lambda *a: masks.append(a) or real(*a))
    for policy in rules.POLICIES:
        got = {r.doc_id for r in rules.filter_documents(docs, policy).collect()}
        assert got == {r.doc_id for r in rules.ledger(docs).filter(real(policy)).collect()}
    assert masks == [(p,) for p in rules.POLICIES]
