import json

from tessera.sources import qa


def test_questions_and_corpus(spark, tmp_path):
    shared = {"title": "Lake", "sentences": ["A lake.", "It is blue."]}
    rows = [
        {"question": "q1", "answer": "a1", "type": "bridge", "supporting_facts": [["Lake", "0"], ["Lake", "1"]], "context": [shared, {"title": "Hill", "sentences": ["A hill."]}]},
        {"question": "q2", "answer": "a2", "type": "simple", "supporting_facts": [["Hill", "0"]], "context": [{"title": "Lake again", "sentences": ["A lake.", "It is blue."]}]},
    ]
    (tmp_path / "qa.json").write_text(json.dumps(rows))
    q = qa.read(spark, str(tmp_path / "qa.json"))
    assert [r.question for r in q.orderBy("query_id").collect()] == ["q1", "q2"]
    assert [r.question for r in qa.read(spark, str(tmp_path / "qa.json"), 1).collect()] == ["q1"]
    assert sorted((r.title, r.text) for r in qa.corpus(q).collect()) == [("Hill", "A hill."), ("Lake", "A lake.\nIt is blue.")]
    assert sorted(r.id for r in qa.truth(q).collect()) == ["Hill", "Lake"]
    assert [r.question for r in qa.multihop(q).collect()] == ["q1"]
