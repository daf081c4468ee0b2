"""Conversation repair, Merkle manifests and mixes against plain versions, on whole tables and odd rows."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobstrata.llm import merkle, mixing, queries, repair

from . import brute
from .helpers import ODD, differences

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def odd_turns():
    """Conversations of rows of any kind: other roles, nulls, ties, repeats, faults of every sort."""
    dice = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "utility", "Ü", "User"]
    texts = [None, "", " \n", "yes.", "no", "why? \t", "a\nb!", "é…", "😀.", "x" * 20000, "no"]
    for conv in [None, *range(-60, 0)]:
        for _ in range(dice.randrange(1, 14)):
            yield conv, dice.choice([None, *range(10)]), dice.choice(roles[: dice.choice((2, 3, 9))]), dice.choice(texts)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_repair(spark, sf, block):
    known = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = known + list(odd_turns())
    table = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], TURNS + ", digest string, kind int").repartition(3)
    left = list(brute.damage(rows))
    assert sorted(map(repr, left)) == sorted(repr(tuple(r)) for r in repair.damaged(table).select("conv_id", "turn", "role", "text").collect())
    assert not differences(repair.digest(repair.damaged(table), table, block=block), brute.repair(left, rows))


def test_a_long_conversation_is_many_blocks(spark):
    dice = random.Random(5)
    rows = [(7, t, dice.choice(["user", "assistant", "assistant", "tool"]), f"{t % 700}{dice.choice(['.', '', '?'])}") for t in range(4000)]
    table = spark.createDataFrame(rows, TURNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = repair.blocks(table, repair.Costs(), 64)
        assert cut.count() > 60 and cut.select("part").distinct().count() > 1
        assert not differences(repair.digest(table, block=64), brute.repair(rows, rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns_are_legal_and_say_what_was_done(spark, sf):
    table = repair.damaged(spark.read.parquet(f"{sf}/conversations.parquet"))
    told = defaultdict(list)
    for r in repair.repaired(table, keep_deleted=True).orderBy("conv_id", "position").collect():
        told[r["conv_id"]].append(r)
    digests = {r["conv_id"]: r for r in repair.digest(table).collect()}
    assert told.keys() == digests.keys()
    for conv, own in told.items():
        assert "".join(r["edit"] for r in own) == digests[conv]["audit"]
        kept = [r for r in own if r["edit"] != "D"]
        roles = "".join(r["role"][0] for r in kept)
        assert not roles or roles.removeprefix("s") == "ua" * (len(roles) // 2)
        assert brute.hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == digests[conv]["repaired_sha256"]


def test_other_costs_are_followed(spark):
    table = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c.")], TURNS)
    audit = lambda **c: repair.digest(table, costs=repair.Costs(**c)).first()["audit"]
    assert (audit(), audit(delete=1), audit(rerole=0, insert=9)) == ("KIKK", "DKK", "DKK") and audit(delete=9, rerole=0, insert=1) == "IRKK"


def odd_documents():
    dice = random.Random(12)
    for i, text in enumerate(ODD):
        yield -1 - i, dice.choice([None, "", "Ü", "z", "src0"]), dice.choice([None, "de"]), dice.choice([None, 0, -7]), text
    yield from [(None, "z", None, None, "a\nb"), (None, "z", None, None, "a\nc"), (5, "twice", "x", 1, "q\n"), (5, "twice", "x", 1, "q\n"), (6, "alone", "x", 1, None)]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, sf, levels):
    known = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    rows = known + list(odd_documents())
    table = spark.createDataFrame([(*r, "x", 9) for r in rows], DOCS + ", leaf string, position int").repartition(3)
    bent = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = merkle.digest(*merkle.manifest(table, bent, levels=levels))
    want = list(brute.manifest(rows))
    columns = list(want[0])
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(tuple(w.values()) for w in want)
    assert any(w["verified"] for w in want) and not all(w["verified"] for w in want)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27])
def test_traversal_gives_the_paths_of_the_tree(n):
    leaves = [str(i) * 4 for i in range(n)]
    levels = merkle.depth(n)
    tree = merkle.Treehash(levels)
    for leaf in leaves:
        tree.add(leaf)
        assert all(len(w) < merkle.ARITY for w in tree.waiting[:-1])  # what waits is logarithmic
    (root,) = tree.end()
    for leaf, (lefts, rights) in zip(leaves, merkle.traversal(leaves, levels), strict=True):
        node = leaf
        for left, right in zip(lefts, rights, strict=True):
            node = merkle.joined_hash([left, node, right])
        assert node == root and len(lefts) == levels


def test_manifest_tells_any_change(spark):
    table = spark.createDataFrame([(i, "s", "en", 1, f"t{i}") for i in range(10)], DOCS)
    other = F.when(F.col("doc_id") == 3, "t4").otherwise(F.col("text"))
    rows = merkle.verified(*merkle.manifest(table, other)).collect()
    assert [r["doc_id"] for r in rows if not r["verified"]] == [3]


def plain_mix(rows, sizes, aims):
    """Rates of each source's sizes by bisection."""
    rates = {}
    for source, aim in aims.items():
        own = [z for s, z in sizes if s == source and z]
        if not own:
            continue
        mean = sum(own) / len(own)
        low, high = -2000.0, 2000.0
        for _ in range(200):
            mid = (low + high) / 2
            total = sum(z * min(2.0, math.exp(min(5.0, mid * z / mean))) for z in own)
            low, high = (mid, high) if total < aim else (low, mid)
        rates[source] = lambda z, mid=mid, mean=mean: min(2.0, math.exp(min(5.0, mid * z / mean)))
    return rates


def test_mix(spark, sf):
    known = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    rows = known + list(odd_documents()) + [(1000 + i, "same", "en", 1, "five words are in here") for i in range(300)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", size int, copies string").repartition(3)
    got = mixing.digest(mixing.planned(table)).collect()
    words = lambda t: len([w for w in brute.re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    source_of = {(r[0], words(r[4])): r[1] for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[1]] += words(r[4])
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], words(r[4])) for r in rows)
    aims = brute.targets(sizes)
    taken, rates = Counter(), plain_mix(rows, [(r[1], words(r[4])) for r in rows], aims)
    cells = defaultdict(lambda: [0, 0])
    for r in got:
        source = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], aims[source], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[source] += r["taken"]
        cells[source, r["size"]][0] += 1
        cells[source, r["size"]][1] += r["copies"]
    for source, aim in aims.items():
        shortest = min((z for (s, z) in cells if s == source and z), default=0)
        assert abs(taken[source] - aim) <= max(shortest, 1e-2 * aim), source
    for (source, size), (n, copies) in cells.items():  # as the tilt says, but for what longer ones leave over
        if size:
            longer = min((z for (s, z) in cells if s == source and z > size), default=size)
            assert abs(copies - n * rates[source](size)) <= 0.5 + longer / size / 2 + 1e-3 * n, (source, size)


def test_mix_is_the_same_again_and_whole_documents_come_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, again = (Counter(map(tuple, mixing.planned(docs.repartition(k)).collect())) for k in (2, 5))
    assert first == again
    copies = mixing.mixture(docs)
    assert copies.columns == [*docs.columns, "copy_number"]
    assert sum(k[5] * n for k, n in first.items()) == copies.count()


@pytest.mark.parametrize("sizes", list(itertools.islice(itertools.product([1, 5, 40], repeat=5), 0, None, 23)))
def test_targets(spark, sizes):
    own = {None if i == 4 else f"s{i}": z for i, z in enumerate(sizes)}
    got = mixing.targets(spark.createDataFrame(list(own.items()), "source string, source_size long"))
    assert {r["source"]: pytest.approx(r["target"]) for r in got.collect()} == brute.targets(own)


def test_empty_tables(spark):
    turns, docs = spark.createDataFrame([], TURNS), spark.createDataFrame([], DOCS)
    assert repair.digest(repair.damaged(turns), turns).count() == repair.repaired(turns).count() == 0
    assert merkle.digest(*merkle.manifest(docs)).count() == mixing.planned(docs).count() == mixing.mixture(docs).count() == 0
    assert set(queries.QUERIES) >= {"op11_repair", "op12_merkle", "op13_mixing"}
