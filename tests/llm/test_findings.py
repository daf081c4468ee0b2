"""What the review of round 3 found."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from jobstrata.llm import jaccard, pieces

from . import brute
from .helpers import differences, documents


@pytest.mark.parametrize("limit", [jaccard.BROADCAST_IDS, 0])
def test_copies_are_not_sketched(spark, limit, monkeypatch):
    """Of 300 equal texts one publishes parts, so no part is a crowd; beyond the bound of the broadcast all do, with the same result."""
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", limit)
    seen, plain = [], jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda rows: seen.append(rows.select("doc_id").distinct().count()) or plain(rows))
    word = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(word)) for i in range(300)] + [(300, " ".join([*word, "end"])), (301, "other words altogether here and now"), (302, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert not differences(jaccard.joined(df), brute.similar(rows))
    assert seen == [3 if limit else 302]


@pytest.mark.parametrize("n", [100, 200])
def test_single_shingles_are_a_row_each_without_a_join(spark, n):
    """n documents that share four shingles give five rows each, twice as many for twice the group; hot ones are told where they are made."""
    df = spark.range(n).selectExpr("id AS doc_id", "concat('one form that all of these notes share ', id) AS text")
    sets = jaccard.hashes(df, df.select("doc_id"))
    common = set.intersection(*[set(np.frombuffer(r["s"], np.int64).tolist()) for r in sets.collect()])
    assert len(common) == 4
    hot = pa.table({"sig": pa.array(sorted(common, reverse=True)[:2], pa.int64()), "n": pa.array([7, 9], pa.int32())})
    parts = jaccard.single(sets, hot)
    assert parts.count() == 5 * n
    assert {(r["sig"], r["sure"]) for r in parts.where("sure > 0").collect()} == {(s, k) for s, k in zip(hot["sig"].to_pylist(), [7, 9], strict=True)}
    got = jaccard.shared(parts)
    assert got.count() == 4 * n and got.where("hot").count() == 2 * n and got.where("crowd > 4096").count() == 2 * n
    assert "[sig" not in str([x for x in got._jdf.queryExecution().toString().splitlines() if "Join" in x])


ODD = ["a  b", "\n\n x", "  lead", "tab\tx", "a\n b", "trail  ", "it\u2581is", "\U0001f600 x\U0001f600y", "\x00 \ue000", "y" * 61 + " " + "z" * 60, "\n" * 70 + "a", "naïve—“quoted”…", "12:30, don't!!! ###"]


def test_chunks_solved_together_are_as_solved_alone(spark, sf):
    """Paths, scores and gaps of chunks by arrays are those of one chunk by its units; a chunk is kept once, not as its only unit, too."""
    known = pieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model"))
    rows, _ = documents(spark, sf, ODD)
    chunks = sorted({c for _, t in rows for c in (known._named(t) if t else [])})
    known._meet(set(chunks))
    at = known._places(chunks)
    ids, stop = pieces._gathered(*known.best_ids, at)
    got = list(zip(np.split(ids, stop[:-1]), known.best_score.whole[at], known.gap.whole[at], strict=True))
    for c, (own, best, gap) in zip(chunks, got, strict=True):
        want = known._by_units(c)
        assert own.tobytes() == want[0] and best == pytest.approx(want[1], abs=1e-9) and gap == pytest.approx(want[2], abs=1e-9), c
    assert len(chunks) > 1000 and any(x[2] == np.inf for x in got) and any(x[2] < 1 for x in got)
    known.units.clear()
    texts = [t for _, t in rows]
    together = list(known.ranked(texts, 4))
    assert len(known.units) < len(known.chunks) / 4  # only of odd chunks
    alone = pieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), limit=0)
    for text, (found, best, same) in zip(texts, together, strict=True):
        assert (found, best) == alone.segmentations(text, 4)
        assert same == (alone.decode(np.frombuffer(found[0][1], "<u4").tolist()) == (text or ""))
    assert not all(same for *_, same in together)
