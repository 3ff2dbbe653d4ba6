import json

import pytest

from tessera.sources import datasets


def put(path, *objects):
    path.write_text("\n".join(o if isinstance(o, str) else json.dumps(o) for o in objects))
    return str(path)


def test_jsonl_skips_blank_lines(spark, tmp_path):
    assert datasets.jsonl(spark, put(tmp_path / "a.jsonl", {"a": 1}, "", {"a": 2}), "a int").count() == 2


def test_unified_round_trip_and_version(spark, tmp_path):
    d = spark.createDataFrame([("d1", "x", "T", "text", "s", ["t"], ["k"], {"a": "b"})], datasets.DOCUMENT)
    q = spark.createDataFrame([("q1", "x", "Q?", "A", ["d1"], ["d1"], {})], datasets.QUERY)
    datasets.write_unified(d, q, str(tmp_path / "out"), "x", "v1")
    docs, queries = datasets.unified(spark, str(tmp_path / "out"), "v1")
    assert docs.collect() == d.collect() and queries.first().supporting_doc_ids == ["d1"]
    with pytest.raises(Exception, match="unknown schema_version"):
        datasets.unified(spark, str(tmp_path / "out"), "v2")[0].collect()
    few, kept = datasets.first_queries(docs, queries, "id", 1)
    assert few.count() == kept.count() == 1
    assert datasets.nodes(docs).first().keywords == ["text"]


def test_hotpot(spark, tmp_path):
    context = [["Film A", ["Film A was made by B.", "Good."]], ["B", ["B is a person."]], ["C", ["Other."]]]
    rows = [
        {"_id": "1", "question": "q", "answer": "a", "supporting_facts": [["Film A", 0], ["B", 0]], "context": context},
        {"_id": "2", "question": "q", "answer": "a", "supporting_facts": [["Film A", 0]], "context": context},
        {"_id": "3", "question": "q", "answer": "a", "supporting_facts": [["B", 0], ["C", 0]], "context": context},
        {"_id": "4", "question": "q", "answer": "a", "supporting_facts": [["B", 0], ["D", 0]], "context": context},
    ]
    docs, queries = datasets.hotpot(spark, put(tmp_path / "h.json", json.dumps(rows)), 5, 10)
    assert [r.id for r in queries.collect()] == ["1"]
    assert queries.first().supporting_doc_ids == ["hotpotqa_1_0", "hotpotqa_1_1"] and len(queries.first().candidate_doc_ids) == 3
    first = docs.orderBy("paragraph_index").first()
    assert first.text == "Film A was made by B. Good." and first.entities == ["Film A", "B"] or set(first.entities) == {"Film A", "B", "C"}


def test_litsearch(spark, tmp_path):
    q = put(tmp_path / "q.jsonl", {"query_set": "s", "query": "find", "specificity": 1, "quality": 2, "corpusids": [1001]}, {"query_set": "s", "query": "lost", "specificity": 1, "quality": 2, "corpusids": [9]})
    c = put(tmp_path / "c.jsonl", *[{"corpusid": i, "title": f"t{i}", "abstract": "x", "citations": [1002]} for i in (1001, 1002, 1003)])
    docs, queries = datasets.litsearch(spark, q, c, 5)
    assert docs.count() == 3 and docs.where("id = 'litsearch_doc_1001'").first().citations == ["litsearch_doc_1002"]
    assert [r.supporting_doc_ids for r in queries.collect()] == [["litsearch_doc_1001"]]


def test_scifact(spark, tmp_path):
    c = put(tmp_path / "corpus.jsonl", {"doc_id": 1001, "title": "T", "abstract": ["First.", "Second."], "structured": False})
    q = put(tmp_path / "claims.jsonl", {"id": 7, "claim": "C", "evidence": {"1001": [{"label": "SUPPORT", "sentences": [0]}]}, "cited_doc_ids": [1001, 1002]})
    docs, queries, evidence = datasets.scifact(spark, c, q)
    assert docs.first().text == "First. Second."
    assert queries.first().supporting_doc_ids == ["scifact_doc_1001"] and queries.first().candidate_doc_ids == ["scifact_doc_1001", "scifact_doc_1002"]
    e = evidence.first()
    assert (e.label, e.sentences, e.rationale) == ("SUPPORT", [0], ["First."])


def test_qasper(spark, tmp_path):
    row = {
        "id": "paper_1", "title": "P", "full_text": {"section_name": ["Introduction", "Method"], "paragraphs": [["Intro text."], ["Method text."]]},
        "qas": [{"question": "Q?", "question_id": "q1", "answers": [{"answer": {"free_form_answer": "", "extractive_spans": ["Intro"], "evidence": ["Intro text."], "highlighted_evidence": [], "unanswerable": False, "yes_no": None}}]}],
    }
    docs, queries = datasets.qasper(spark, put(tmp_path / "q.jsonl", row))
    first = docs.orderBy("position").first()
    assert first.id == "qasper_paper_1_para_0000" and first.context_path == ["paper:paper_1", "section:Introduction", "paragraph:0"]
    assert (queries.first().answer, queries.first().supporting_doc_ids) == ("Intro", ["qasper_paper_1_para_0000"])


def test_novel_chunks_and_evidence(spark, tmp_path):
    (tmp_path / "b1.txt").write_text("The plot thickens in the castle. " * 20)
    chunks = datasets.novel_chunks(spark, str(tmp_path / "*.txt"), 80, 10)
    assert chunks.count() > 3 and chunks.first().book_id == "b1"
    e = spark.createDataFrame([("e1", "b1", "plot thickens in the castle"), ("e2", "b1", "thickens castle nowhere"), ("e3", "b1", "unrelated words")], "key string, book_id string, evidence string")
    assert {r.key for r in datasets.best_chunk(e, chunks).collect()} == {"e1", "e2"}
