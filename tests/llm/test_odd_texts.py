"""Texts of endless runs, and very long ones, through every operator."""

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from vecloom.llm import best_fit_packing, chat_format, near_copies, quality_rules, secret_scan, simhash_dedup, stratified_shards, suffix_decontam, tier_packing, warc_revisit, zstd_language
from vecloom.llm.common import materialize

TEXTS = [
    " " * 1_000_000,
    "a" * 500_000,
    "\n" * 300_000,
    "=" * 300_000,
    "password: " * 30_000,
    "0123456789abcdef" * 20_000,
    "token=" + "x" * 300_000,
    "user=" * 40_000,
    "https://" * 40_000,
    "é" * 200_000,
    "one two three four five six seven eight nine ten. " * 20_000,
    " ".join(f"w{i}" for i in range(150_000)),
    "\u200b\ufeff" * 1000,
    None,
]
COUNT = len(TEXTS)


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame([(i, t, "en", "s", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4), "test")


def test_scans(docs):
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    assert len(rows) == COUNT and rows[5]["n_hex"] == 1 and rows[6]["n_assign"] == 1
    assert secret_scan.redact(docs).count() == COUNT


def test_rules(docs):
    rows = {r["row"]["doc_id"]: r for r in quality_rules.apply_rules(docs, carry=["doc_id"]).collect()}
    assert len(rows) == COUNT and rows[0]["n_words"] == 0 and rows[1]["word_chars"] == 500_000 and rows[11]["n_words"] == 150_000 and rows[10]["base_failed"]


def test_near_copies(docs):
    # Texts without words are copies of each other; so are a text and itself, and nothing else here.
    twice = docs.union(docs)
    assert simhash_dedup.dedup(twice).count() == 2 * COUNT
    assert sorted(r["doc_id"] for r in near_copies.keep_first(twice).collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "w5 w6 w7"), (2, "nine ten one"), (3, "é" * 200_000), (4, "a " * 30_000)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in suffix_decontam.report(docs, items).collect()}
    assert {i: r["n_hit"] for i, r in rows.items() if r["n_hit"]} == {11: 3, 10: 3 * 19_999, 9: 1}


def test_language(docs):
    rows = zstd_language.classify(docs, zstd_language.learn(docs), ["doc_id"]).collect()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {0, 2, 3, 12, 13}


def test_shards(docs):
    assert stratified_shards.shard(docs).select("slot", "shard").distinct().count() == COUNT


def test_packings(docs):
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}
    got: dict = {}
    for r in tier_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back: dict = {}
    for r in best_fit_packing.read_pieces(materialize(best_fit_packing.blocks(docs, path), "test"), with_ids=True).collect():
        back.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    decode = best_fit_packing.encoding(path).decode
    assert {i: decode(np.concatenate([p for _, p in sorted(x, key=lambda y: y[0])]).tolist()[:-1]) for i, x in back.items()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_chats(docs):
    turns = docs.selectExpr("1L AS conv_id", "doc_id AS turn", "if(doc_id % 5 = 4, 'assistant', 'user') AS role", "text")
    r = chat_format.read_back(chat_format.examples(turns)).head()
    assert r["n_turns"] == COUNT and r["loss_chars"] == sum(len(TEXTS[i] or "") for i in (4, 9))


def test_pages(spark, docs):
    rows = warc_revisit.archive(docs.selectExpr("doc_id AS page_id", "cast(null AS string) AS url", "text AS html")).collect()
    assert {r["page_id"]: r["payload_bytes"] for r in rows} == {i: len((t or "").encode()) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_stages(spark, docs, name, stage):
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.count() > 0 or name == "quality rules"
