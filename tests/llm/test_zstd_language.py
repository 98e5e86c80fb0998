import random
import zlib

from llm_cases import edge_documents
from vecloom.llm import zstd_language as Z
from vecloom.llm.queries import op8_zstd_language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_zstd_language(spark, sf).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)
    sure = [r for r in held if not r["rejected"]]
    assert len(sure) >= 0.9 * len(held)


def test_predictions_against_plain_compression(spark):
    """Every prediction again: each piece compressed with each dictionary in its own frame, sizes summed."""
    import zstandard

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labelled = spark.createDataFrame([(r["text"], r["lang"]) for i, r in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2 and r["lang"] is not None], "text string, lang string")
    dictionaries = Z.learn(labelled)
    how = zstandard.ZstdCompressionParameters(**Z.PARAMETERS)
    for r in op8_zstd_language(spark, sf).collect():
        raw = Z.letters(docs[r["doc_id"]]["text"])
        sizes = {}
        for lang, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(raw[a : a + Z.PIECE_BYTES])) for a in range(0, len(raw), Z.PIECE_BYTES))
        if r["lang_pred"] == Z.UNDETERMINED:
            assert not raw.strip()
            continue
        assert sizes[r["lang_pred"]] <= min(sizes.values()) + 2  # a prepared dictionary may cost a byte or two more or less
        assert not (r["rejected"] and sorted(sizes.values())[1] - min(sizes.values()) > max(Z.MARGIN_BYTES, Z.MARGIN_SHARE * min(sizes.values())) + 2)


def test_many_languages_and_no_ids(spark):
    """None of 90 languages is left out, and what is collected is bounded whatever the ids are."""
    rng = random.Random(2)
    rows = []
    for k in range(90):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(60)]
        rows += [(None, " ".join(rng.choices(words, k=60)), f"l{k}") for _ in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = Z.learn(docs)
    assert len(d) == 90 and sum(map(len, d.values())) <= Z.TOTAL_BYTES + 90 * Z.LEAST_BYTES
    got = Z.classify(docs, d, ["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got)
    many = spark.range(20_000).selectExpr("null AS doc_id", "concat('text of some words ', id, repeat(' and many more of them', 30)) AS text", "'en' AS lang")
    assert 50 < Z.sample(many)[2].count() < 1200
    copies = spark.range(20_000).selectExpr("'the very same text' AS text", "'en' AS lang")
    assert Z.sample(copies)[2].count() == 1


def test_it_learns_only_from_its_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert Z.learn(docs.limit(0)) == {}
    two = Z.learn(docs.where("lang IN ('en', 'de')"))
    assert set(two) == {"en", "de"} and all(len(x) <= Z.DICT_BYTES for x in two.values())
    assert {r["lang_pred"] for r in Z.classify(docs, two, ["doc_id"]).collect()} <= {"en", "de"}
    assert {r["lang_pred"] for r in Z.classify(docs, {}, ["doc_id"]).collect()} == {"und"}


def test_long_texts_count_to_their_end():
    """A head in another language doesn't decide for a long text."""
    rng = random.Random(3)
    words = {k: ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(4000)] for k, letters in (("a", "abcdefghijklm"), ("b", "nopqrstuvwxyz"))}
    text = lambda k, size: " ".join(rng.choices(words[k], k=size // 6))
    c = Z.Classifier({k: text(k, Z.DICT_BYTES).encode()[-Z.DICT_BYTES :] for k in "ab"})
    assert c.predict(text("a", 200_000) + " " + text("b", 3_000_000))[0] == "b"
    assert c.predict(text("b", 100_000) + " " + text("a", 3_000_000))[0] == "a"


def test_edges(spark):
    docs = edge_documents(spark)
    d = Z.learn(docs)
    assert set(d) == {"en"}
    rows = Z.classify(docs, d, ["doc_id"])
    by = [(r["doc_id"], r["lang_pred"]) for r in rows.collect()]
    assert len(by) == docs.count()
    assert {p for i, p in by if i in (1, 2, 5, 6)} == {"und"} and {p for i, p in by if i in (3, 4, None)} == {"en"}
    assert Z.classify(docs.limit(0), d, ["doc_id"]).count() == 0
