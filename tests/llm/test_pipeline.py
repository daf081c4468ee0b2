"""The pipeline against plain versions of its stages."""

import re

import corpus_pipeline
import public_tokenizers

from jobstrata.llm import pieces

from . import brute


def redacted(text):
    """What personal_data makes of a text with base kinds alone."""
    spans = sorted((m.start(), -m.end(), k) for k, p in brute.KINDS.items() for m in re.finditer(p, text) if brute.fits(k, m[0]))
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, -end)
    return "".join(out) + text[at:]


def test_stages_and_run(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r["doc_id"] for r in brute.rules(docs) if r["base_failed"] or 2 * r["n_symbols"] > 3 * r["n_words"] or r["word_chars"] > 40 * r["n_words"]}
    docs = [d for d in docs if d[0] not in bad]
    first = {r["component_id"] for r in brute.similar(docs)}
    docs = [d for d in docs if d[0] in first]
    leaks = {r["doc_id"] for r in brute.leaked(docs, bench) if r["contaminated"]}
    docs = [(d, t) for d, t in docs if d not in leaks]
    model = pieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: len(model.encode(redacted(t))[0]) // 4 for d, t in docs}
    got = {r["doc_id"]: r["n_pieces"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert sum(got[d] == want[d] for d in want) >= len(want) - 3  # added kinds may differ in a few texts


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), sf).columns == docs.columns
