import corpus_pipeline as C
import public_tokenizers
import pytest
from llm_cases import edge_documents
from test_near_copies import brute as classes
from test_quality_rules import plain_kept
from test_suffix_decontam import brute as hits
from tokenizers import Tokenizer
from vecloom.llm import secret_scan
from vecloom.llm.common import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def masked(text):
    """Each run of overlapping findings becomes the name of the first one."""
    base, more, _ = secret_scan.scan_text(text)
    runs = []
    for start, kind, end in sorted([*base, *more]):
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end, kind])
    for start, end, kind in reversed(runs):
        text = f"{text[:start]}[{secret_scan.KINDS[kind]} removed]{text[end:]}"
    return text


def test_pipeline_against_plain_versions(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = {i: docs[i] for i in plain_kept(docs)}
    docs = {i: docs[i] for i, c in classes(docs).items() if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {r[0]: docs[r[0]] for r in hits(docs.items(), items) if not r[5]}
    docs = {i: masked(t) for i, t in docs.items()}
    tokens = Tokenizer.from_file(public_tokenizers.path(C.TOKENIZER))
    want = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    rows = C.run(spark, SF).collect()
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == want[r["doc_id"]]
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test")
        assert docs.columns == COLUMNS and docs.count() > 100
    assert docs.where("n_chars <> char_length(text)").count() == 0


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    docs = edge_documents(spark)
    out = stage(spark, docs, SF)
    assert out.count() <= 200
    assert stage(spark, docs.limit(0), SF).count() == 0
