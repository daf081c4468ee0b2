"""What the first review found missing in the library's queries."""

from difflib import SequenceMatcher
from itertools import combinations

from jobstrata.plans import catalogue


def saved(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def clusters(ids, pairs):
    """The smallest id of each id's transitive cluster."""
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_copies_of_any_length_fold(spark, tmp_path):
    head = "the same beginning of every text in this block " * 4
    long = head + " ".join(f"word{i % 97}" for i in range(1_000))
    short = head + "a middling text about nothing in particular " * 8
    texts = [long, short, long, long + " the end", short.replace("middling", "meddling"), long[:4_000], head, head, None, "x" + long, short + long[:80], "unlike " * 80]
    rows = [(i, t, "en", "s" if i != 3 else None) for i, t in enumerate(texts)]
    rows += [(20 + i, t, "en", None) for i, t in enumerate((long + " the end", long))]
    where = saved(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string")
    block = lambda r: (r[3], r[2], r[1][:150])
    compared = [r for r in rows if r[1] and len(r[1]) >= 400]
    pairs = [(a[0], b[0]) for a, b in combinations(compared, 2) if block(a) == block(b) and SequenceMatcher(None, a[1], b[1], autojunk=False).ratio() >= 0.93]
    want = clusters([r[0] for r in rows], pairs)
    assert want[2] == 0 and want[21] == want[20] == 3 and want[4] == 1 and want[7] == 7
    members = list(want.values())
    got = catalogue.queries()["dup_near"](spark, where).collect()
    assert {(r["id"], r["component"], r["members"], r["kept"]) for r in got} == {(i, c, members.count(c), i == c) for i, c in want.items()}
    assert len(got) == len(rows)


def test_changes_far_down_a_page_are_seen(spark, tmp_path):
    body = "<p>seen &amp; read</p>" * 300
    where = saved(spark, tmp_path, "pages", [(1, "u", body + "a"), (2, "u", body + "b"), (3, "u", body + "<br>a"), (4, "u", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["visible"] for r in catalogue.queries()["txt_visible_whole"](spark, where).collect()}
    assert got[1] == got[3] != got[2] and got[4] is None
