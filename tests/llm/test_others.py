"""The other operators against plain versions, exact round trips or held-out accuracy."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobstrata.llm import components, cotrain, jaccard, pieces, substring, tokenbin, toxicity, warc

from . import brute
from .helpers import differences, documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_substrings(spark, sf):
    rows, df = documents(spark, sf)
    assert not differences(substring.digest(substring.removed(df)), brute.removed(rows))


def test_passages_double_until_nothing_survives(spark):
    long = " ".join(f"w{i}" for i in range(70))
    df = spark.createDataFrame([(1, "a b " + long), (2, long + " c"), (3, long[:80]), (4, "q r s")], "doc_id long, text string")
    assert {(r["doc_id"], r["longest"]) for r in substring.passages(df).collect()} == {(1, 52), (2, 52), (3, 13)}


def mutated(seed, n=60, copies=90):
    """Groups of near copies of short and long texts, and texts that share a passage."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(n):
        own = [word() for _ in range(pick.choice([3, 6, 9, 20, 70, 150]))]
        for _ in range(pick.choice([1, 1, 2, 4])):
            near = [w if pick.random() > 0.02 else word() for w in own]
            out.append(near + passage * pick.choice([0, 0, 1]))
    base = [word() for _ in range(80)]
    out += [[w if pick.random() > 0.03 else word() for w in base] for _ in range(copies)]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("crowd", [3, 64])
def test_similar_documents(spark, crowd, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rows = mutated(crowd)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not differences(jaccard.joined(df), brute.similar(rows))


def test_similar_documents_of_the_table(spark, sf):
    rows, df = documents(spark, sf)
    assert not differences(jaccard.joined(df), brute.similar(rows))
    kept = {r["doc_id"] for r in jaccard.representatives(df).collect()}
    assert kept == {r["component_id"] for r in brute.similar(rows)}


def test_partners_share_published_parts(spark):
    pick = np.random.default_rng(5)
    for n in [*range(1, 60), 100, 333, 1000]:
        a = np.unique(pick.integers(0, 1 << 63, n, dtype=np.uint64))
        b = a.copy()
        while True:  # as far from each other as the threshold allows
            c = np.append(b[1:], pick.integers(0, 1 << 63, 1, dtype=np.uint64))
            if 100 * len(np.intersect1d(a, c)) < 75 * len(np.union1d(a, c)):
                break
            b = np.unique(c)
        spare = int(jaccard.SLACK * (min(len(a), len(b)) // 3 + 1))
        assert len(np.intersect1d(jaccard.published(a), jaccard.published(b))) > spare or len(np.intersect1d(jaccard.published(a), jaccard.published(b))) > 0 and spare == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(50)}


def test_tokens(spark, sf):
    rows, df = documents(spark, sf, ["it's <|endoftext|> x<|endoftext|>y ΑΣ Σ a\x0bb\x1cc", "ÀÉ! don't. 'S ½ ǅ"])
    assert not differences(tokenbin.digest(tokenbin.written(df, WORDS)), brute.tokens(rows, Tokenizer.from_file(WORDS)))


@pytest.mark.parametrize("n", [1, 7, 8, 511, 512, 513, 5000])
def test_any_token_is_read_alone(n):
    ids = np.random.default_rng(n).choice([0, 2, 255, 256, 49407, 65536, 2**31], n).astype(np.uint32)
    block = tokenbin.Block(*tokenbin.encoded(ids))
    assert [block.token(i) for i in range(n)] == ids.tolist()
    for a, b in [(0, n), (n // 2, n), (n // 3, n // 2), (n, n)]:
        assert block.tokens(a, b).tolist() == ids[a:b].tolist()


def test_archives(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()] + [(-1, None), (-2, ""), (-3, "y" * 100), (-4, "y" * 100), (-5, "y" * 99), (-6, "y" * 99)]
    df = spark.createDataFrame([(i, f"http://h/{i} é", t, "x") for i, t in rows], "page_id long, url string, html string, first string")
    path = warc.archived(df)
    assert not differences(warc.digest(warc.read(spark, path)), brute.archived(rows))
    some = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    assert {(r["page_id"], r["refers_to"], r["payload"]) for r in some.collect()} >= {(-3, -4, None)}
    assert warc.read(spark, path).where(F.col("page_id").isin(-5, -6)).count() == 2
    assert warc.read(spark, warc.archived(df.limit(0))).count() == 0


def test_payloads_that_are_not_wanted_are_never_read(tmp_path):
    import io

    row = {"record_type": "response", "page_id": 1, "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_bytes": 3, "payload": b"abc"}
    data = warc.record_bytes(row) + warc.record_bytes(row | {"page_id": 2})
    broken = data.replace(b"\x1f\x8b", b"\0\0", 1)
    assert [r["payload"] for r in warc.records(io.BytesIO(data), len(data), lambda r: True, True)] == [b"abc", b"abc"]
    assert [r["payload"] for r in warc.records(io.BytesIO(broken), len(data), lambda r: r["page_id"] == 2, True)] == [b"abc"]


@pytest.fixture(scope="module")
def segmenter():
    return pieces.Segmenter(PIECES)


def test_n_best_are_the_best(segmenter):
    pick, library = random.Random(1), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for _ in range(200):
        text = "".join(pick.choice("ab e.,\nthé日 1") for _ in range(pick.randint(1, 14)))
        whole = pieces.SPACE + text.replace(" ", pieces.SPACE)
        ends, paths = segmenter.edges(whole), {0: [(0.0, ())]}
        for j in range(1, len(whole) + 1):
            paths[j] = sorted(((s + score, ids + own) for i, score, own in ends[j] for s, ids in paths[i]), key=lambda x: -x[0])[:30]
        got = segmenter.nbest(text, 4)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in paths[len(whole)][:4]]
        assert all(segmenter.decode(ids) == text == library.decode(ids) for _, ids in got)


def test_the_model_s_own_comes_first_then_the_best_others(segmenter):
    pick, library = random.Random(2), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for k in range(300):
        text = "".join(pick.choice(["ab ", "e.,", "\n", "the ", "é日", "  1", "in", "ation"]) for _ in range(pick.randint(0, 12)))
        own, best = segmenter.segmentations(text, 4)
        assert np.frombuffer(own[0][1], "<u4").tolist() == library.encode(text)
        lattice = [x for x in segmenter.packed(text, 5) if x[1] != own[0][1]][:3]
        assert [round(x[0], 6) for x in own[1:]] == [round(x[0], 6) for x in lattice] and len({x[1] for x in own}) == len(own)
        if text:  # its score is that of its path in the lattice
            ends = segmenter.edges(pieces.SPACE + text.replace(" ", pieces.SPACE))
            paths = {0: [(0.0, b"")]}
            for j in range(1, len(ends)):
                whole = own[0][1]
                paths[j] = [(s + score, t + np.array(ids, "<u4").tobytes()) for i, score, ids in ends[j] for s, t in paths[i] if whole.startswith(t + np.array(ids, "<u4").tobytes())]
            assert [round(s, 6) for s, t in paths[len(ends) - 1] if t == own[0][1]] == [round(own[0][0], 6)] and round(best, 6) >= round(own[0][0], 6)


def test_segmentation_of_the_table(spark, sf):
    rows, df = documents(spark, sf)
    got = {r["doc_id"]: r for r in pieces.digest(df, PIECES).collect()}
    assert all(got[d]["round_trip"] for d, _ in rows)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {d: r["ids_crc32"] for d, r in got.items()} == {d: zlib.crc32(np.array(library.encode(t or ""), "<u4").tobytes()) for d, t in rows}
    assert got[-1]["n_pieces"] == 0
    ids = pieces.encoded(df, PIECES)
    assert {r["doc_id"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in ids.collect()} == {d: r["ids_crc32"] for d, r in got.items()}
    assert {(r["doc_id"], r["text"]) for r in pieces.decoded(ids, PIECES).collect()} == {(d, t or "") for d, t in rows}
    assert pieces.nbest(df.where("doc_id < -3"), PIECES, 3).where("rank = 1").count() == len([d for d, _ in rows if d < -3])


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_toxic_documents_that_were_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.trained(docs, labels, 1500)
    held = toxicity.scored(docs, model).where("held_out").join(labels, "doc_id").collect()
    assert auc([(r["score"], r["toxic"]) for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in held)
    odd = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "Fine. You idiot moron loser! Bye.", "z")], "doc_id long, text string, score string")
    assert [r["score"] for r in toxicity.scored(odd, model).orderBy("doc_id").collect()][:2] == [0.0, 0.0]
    assert [(r["sentence"], r["start"]) for r in toxicity.located(odd, model).collect()] == [(1, 5)]


def test_quality_of_documents_that_were_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = cotrain.trained(docs, labels, 600, 800)
    assert model.history and sum(h["to_text"] + h["to_metadata"] for h in model.history)
    held = cotrain.scored(docs, model).where("held_out").join(labels, "doc_id").collect()
    assert auc([(r["score"], r["quality"]) for r in held]) > 0.95
    assert sum(r["kept"] for r in held if r["quality"]) > 0.98 * sum(1 for r in held if r["quality"])


def test_models_without_labels_say_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {round(r["score"], 9) for r in toxicity.scored(docs, toxicity.trained(docs, none)).collect()} == {0.0}
    assert {r["score"] for r in cotrain.scored(docs, cotrain.trained(docs, none)).collect()} == {0.5}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for found in (substring.removed(none), jaccard.joined(none), tokenbin.digest(tokenbin.written(none, WORDS)), pieces.digest(none, PIECES)):
        assert found.count() == 0
