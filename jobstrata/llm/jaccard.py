"""Exact n-gram Jaccard join by parity sketches.

A document's shingles are dealt by hash to the P parts of a sketch, and a part is the XOR of its shingles' hashes. A shingle that
one of two documents lacks changes one part, so the number of parts that differ is at most the symmetric difference, which for a
similarity of 3/4 is at most D, a third of either set's size. By the pigeonhole principle a document needs to publish D + 1 parts
that aren't empty to share one with every partner. P is fixed for a band of sizes (one to two), and a document just above a band's
end publishes in that band, too. Sets with too few parts that aren't empty are sketched again with other seeds.

1. Each document publishes its first D + 1 parts and some more (`SLACK`), so partners share that many more. In groups of up to `CROWD`
   documents all pairs are candidates, in larger ones only links to a centre. A document that lost no more parts to
   such crowds than it had to spare has met all its partners.
2. Documents that lost more, one of each class of equal sets, are sketched so finely that each shingle is a part of its own. Of
   those each keeps the few that fewest others have: as many as it may lack and one, which are fewer (`short`) towards partners of
   its own size or above. A pair must meet in a part that the smaller keeps as short, so texts from one template that differ by more
   than a link allows never meet, however many they are. Groups are treated as before.
3. Crowds that are left are near copies. Of their documents those outside the largest component that verified links have made so far
   are compared with all of another component, in blocks of `BLOCK` shingles and `DOCS` documents, a pair of blocks a row; only
   verified links come out.

Candidates are verified twice: by the Hamming distance of one-bit sketches, which is at most the symmetric difference and needs a
sixteenth of the bytes, then on the shingles' 64-bit hashes. So no link between different texts is lost, and copies are never compared.

Parts that more than `CROWD` of `SAMPLE` documents publish are crowds beyond doubt; their rows are spread over `SPREAD` tasks. The sample
decides nothing else: all other groups are read whole.

Null and empty texts have no shingles and are linked with nothing; an empty table gives an empty result. Very long texts are hashed in
linear time and held one at a time. Rows with one doc_id count as copies of the one with most shingles, of equals one by their
hash. Rows with a null doc_id are left out. Ties have no effect: results are sets of links and smallest ids. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.identity import components
from .common import lean, long_array, mixed, stored, text_bytes, windows, word_hashes

WIDTH, PERCENT = 5, 75
SLACK, CROWD, SEEDS, BLOCK, DOCS = 0.2, 64, 8, 20_000, 500
#: Groups from this size on are equally crowded in the order of parts; so many rows are held at most to count one.
COUNTED = 4096
#: Documents among which surely crowded parts are looked for, and tasks over which the rows of such a part are spread.
SAMPLE, SPREAD = 8_000, 32
#: Ids that may be broadcast to pick documents; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; several times faster than np.unique, which hashes them first."""
    own = np.sort(values)
    return own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct shingles of lower-cased words, sorted; of fewer words than width the whole is one."""
    if not words:
        return np.empty(0, np.uint64)
    short = len(words) < width
    found = windows(word_hashes(words), len(words) if short else width)
    return _distinct(mixed(found + np.uint64(len(words))) if short else found)


def _band(size: int) -> int:
    return size.bit_length() - 1


def published(own: np.ndarray) -> np.ndarray:
    """The parts that a set of shingles publishes, as 58 bits of hash and 6 of its band."""
    n, out = len(own), []
    need = n // 3 + 1
    most = need + int(SLACK * need)
    for band in {_band(n), _band(-(-3 * n // 4))}:
        parts = int(1.5 * (4 * (2 << band) // 9)) + 4
        for seed in range(SEEDS + 1):
            salt = np.uint64(0x9E3779B97F4A7C15 * (64 * seed + band + 1) % (1 << 64))
            if seed == SEEDS:
                out.append(np.array([salt], np.uint64))
                break
            dealt = mixed(own ^ salt)
            part = (dealt >> np.uint64(33)).astype(np.uint32) % np.uint32(parts)
            part = part.astype(np.uint16) if parts <= 1 << 16 else part  # 16 bits are sorted by radix
            order = np.argsort(part, kind="stable")
            part = part[order]
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            xor = np.bitwise_xor.reduceat(dealt[order], starts)[:most]
            some = mixed(xor + part[starts[:most]])
            out.append(some & np.uint64((1 << 64) - 64) | np.uint64(band))
            if len(starts) >= most:
                break
    return _distinct(np.concatenate(out))


def _emit(docs: DataFrame, row, schema: str, names: list[str]) -> DataFrame:
    """row(doc_id, shingles) gives arrays of equal length, the columns."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                parts = [row(doc_id, shingles(text.lower().split())) for doc_id, text in zip(some["doc_id"].to_pylist(), text_bytes(some["text"]), strict=True)]
                parts = [p for p in parts if p is not None]
                if parts:
                    yield pa.RecordBatch.from_arrays([_column(x) for x in zip(*parts, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(emit, schema)


def _column(values) -> pa.Array:
    if isinstance(values[0], np.ndarray):
        whole = np.concatenate(values)
        return pa.array(whole) if whole.dtype == bool else long_array(whole)
    return pa.array(values, pa.binary() if isinstance(values[0], bytes) else pa.int64())


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and key, equal for equal sets."""

    def row(doc_id, own):
        again = mixed(own)
        return doc_id, len(own), np.array([np.bitwise_xor.reduce(own) if len(own) else 0, again.sum(dtype=np.uint64), len(own)], np.uint64).tobytes()

    return _emit(docs, row, "doc_id long, n_shingles long, key binary", ["doc_id", "n_shingles", "key"])


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and rep: the smallest id with an equal set (its own, of an empty set)."""
    own = sets(docs).groupBy("doc_id").agg(F.max(F.struct("n_shingles", "key")).alias("s")).select("doc_id", "s.*")
    own = stored(own, "keys")
    first = own.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first.drop("n"), "firsts")  # a plain exchange on either side lets Spark split a key that very many copies have
    return own.join(first, "key", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("rep"))


def parity(own: np.ndarray) -> bytes:
    """One bit a part, whether its shingles are odd in number; parts: the power of two from four times the shingles up, 64 at least."""
    size = 1 << max(6, (4 * len(own) - 1).bit_length())
    at = (mixed(own ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def _differ(x: np.ndarray, y: np.ndarray) -> int:
    """In how many parts two sketches differ; the longer is folded first, which gives that of fewer parts."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def _near(x: bytes, nx: int, y: bytes, ny: int, percent: int) -> bool:
    """Whether the sketches allow a link: they differ in no more parts than the sets may in shingles."""
    return _differ(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) * (100 + percent) <= (nx + ny) * (100 - percent)


def crowds(rows: DataFrame) -> DataFrame:
    """sig and n: parts that more than CROWD of the sampled rows (sig) have. A row for CROWD of the sample's parts at most."""
    return stored(rows.groupBy("sig").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") > CROWD), "crowds")


def sketches(docs: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
    """sig, doc_id and hot: the published parts of each document, and whether a part is among the sorted hot ones."""
    known = np.empty(0, np.int64) if hot is None else hot

    def row(doc_id, own):
        if len(own):
            sig = published(own).view(np.int64)
            return sig, np.full(len(sig), doc_id, np.int64), np.isin(sig, known)
        return None

    return _emit(docs, row, "sig long, doc_id long, hot boolean", ["sig", "doc_id", "hot"])


def spread(rows: DataFrame) -> DataFrame:
    """rows with those of a part in one task, in order; those of a hot part in SPREAD tasks."""
    lot = F.xxhash64("sig", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    return rows.repartition(F.when(F.col("hot"), lot).otherwise(F.col("sig"))).sortWithinPartitions("sig", "doc_id")


def grouped(batches: Iterator[pa.RecordBatch], names: list[str], most: int) -> Iterator[tuple]:
    """The columns of whole small groups, and of crowds as far as read: (columns, starts, sizes, crowd, centre).

    Columns are those of names, which start with sig, doc_id and hot. A group is a crowd if it is hot or has more than `most` rows; its centre is
    its first document here. `most` rows and a batch are held at most.
    """
    held, star = None, None
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            own = [batch[n].to_numpy(zero_copy_only=False) for n in names]
            held = own if held is None else [np.concatenate([h, c]) for h, c in zip(held, own, strict=True)]
        if held is None or not len(held[0]):
            continue
        sig = held[0]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        sizes = np.diff(np.append(starts, len(sig)))
        crowd, centre = (sizes > most) | held[2][starts], held[1][starts].copy()
        if star is not None and star[0] == sig[0]:
            crowd[0], centre[0] = True, star[1]
        upto = len(starts) if batch is None or crowd[-1] else len(starts) - 1
        star = (sig[-1], centre[-1]) if crowd[-1] else None
        if upto:
            end = starts[upto] if upto < len(starts) else len(sig)
            yield [h[:end] for h in held], starts[:upto], sizes[:upto], crowd[:upto], centre[:upto]
        held = [h[starts[upto] :] for h in held] if upto < len(starts) else [h[:0] for h in held]


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of both rows of all pairs in the groups given, first before second."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in np.unique(sizes[sizes > 1]):
        at = starts[sizes == n]
        x, y = np.triu_indices(n, 1)
        left.append((at[:, None] + x).ravel())
        right.append((at[:, None] + y).ravel())
    return np.concatenate(left), np.concatenate(right)


def candidates(rows: DataFrame) -> DataFrame:
    """a, b, band, crowd and sig of rows (sig, doc_id, hot): pairs (a < b) of documents in a small group; of a crowd (centre, id), itself included.

    sig only for the centres of hot parts, which have several.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sig, doc, hot), starts, sizes, crowd, centre in grouped(batches, ["sig", "doc_id", "hot"], CROWD):
            x, y = _pairs(starts[~crowd], sizes[~crowd])
            of = np.repeat(np.where(crowd, centre, 0), sizes)
            z = np.flatnonzero(np.repeat(crowd, sizes))
            a, b = np.concatenate([doc[x], of[z]]), np.concatenate([doc[y], doc[z]])
            at = np.concatenate([x, z])
            told = np.concatenate([np.zeros(len(x), bool), hot[z] & (of[z] == doc[z])])
            many = np.arange(len(a)) >= len(x)
            for k in range(0, len(a), 50_000):
                s = slice(k, k + 50_000)
                band = pa.array((sig[at[s]] & 63).astype(np.int8))
                yield pa.RecordBatch.from_arrays([pa.array(a[s]), pa.array(b[s]), band, pa.array(many[s]), pa.array(sig[at[s]], mask=~told[s])], ["a", "b", "band", "crowd", "sig"])

    return spread(rows).mapInArrow(scan, "a long, b long, band byte, crowd boolean, sig long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def hashes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, n, bits (parities) and s, the packed shingles, of the documents among nodes (doc_id, stored). Few ids are broadcast, so texts stay where they are."""
    chosen = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    own = _emit(docs.join(chosen, "doc_id"), lambda doc_id, s: (doc_id, len(s), parity(s), s.tobytes()), "doc_id long, n long, bits binary, s binary", ["doc_id", "n", "bits", "s"])
    return own.groupBy("doc_id").agg(F.max(F.struct("n", "s", "bits")).alias("x")).select("doc_id", "x.n", "x.bits", "x.s")


def verified(sets: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose sets' similarity is percent or more. sets: doc_id, n, bits and s, of which only sets that bits let pass are joined."""
    side = lambda c, *names: sets.select(F.col("doc_id").alias(c), *[F.col(x).alias(f"{x}{c}") for x in names])

    def passed(batches: Iterator[pa.RecordBatch], test, columns: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                mask = pa.array([test(*x) for x in zip(*[some[c].to_pylist() for c in columns], strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([some["a"].filter(mask), some["b"].filter(mask)], ["a", "b"])

    near = lambda x, nx, y, ny: _near(x, nx, y, ny, percent)
    same = lambda x, y: _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
    close = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b").mapInArrow(lambda it: passed(it, near, ["bitsa", "na", "bitsb", "nb"]), "a long, b long")
    return stored(close, "close").join(side("a", "s"), "a").join(side("b", "s"), "b").mapInArrow(lambda it: passed(it, same, ["sa", "sb"]), "a long, b long")


def single(sets: DataFrame, hot: pa.Table | None = None) -> DataFrame:
    """sig, doc_id, n and sure: each shingle of sets (doc_id, n, s) as a part of its own, the size of its set, and the n of hot (sig, n) or 0.

    One row for each shingle, however many sets have it.
    """
    keys, counts = (np.empty(0, np.int64), np.empty(0, np.int32)) if hot is None else (hot["sig"].to_numpy(), hot["n"].to_numpy())
    order = np.argsort(keys)
    keys, counts = np.append(keys[order], np.int64(0)), np.append(counts[order], np.int32(0))  # the last is for what lies beyond all keys


    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                each = [np.frombuffer(s, np.int64) for s in some["s"].to_pylist()]
                sizes = np.array([len(x) for x in each], np.int64)
                sig = np.concatenate(each)
                at_key = np.searchsorted(keys[:-1], sig)
                sure = np.where(keys[at_key] == sig, counts[at_key], np.int32(0))
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.repeat(some["doc_id"].to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(sure)], ["sig", "doc_id", "n", "sure"])

    return sets.select("doc_id", "s").mapInArrow(emit, "sig long, doc_id long, n int, sure int")


def shared(parts: DataFrame) -> DataFrame:
    """The rows of parts (sig, doc_id, n, sure) whose sig comes in another row, with crowd, how many have it (COUNTED at most; of those with sure more), and hot.

    Rows sorted by sig are read as a stream, so one shuffle does; COUNTED rows and a batch are held at most. The order by (crowd, sig) is the same for
    all documents, which is all that the choice of parts needs.
    """
    names = ["sig", "doc_id", "n", "sure"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None

        def ready(upto: int, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            whole = np.diff(np.append(starts, upto))
            crowd = np.repeat(np.minimum(whole, COUNTED), whole)
            crowd[held[0][:upto] == large] = COUNTED
            sure = held[3][:upto]
            crowd = np.where(sure > 0, COUNTED + sure, crowd)
            good = crowd > 1
            if good.any():
                yield pa.RecordBatch.from_arrays([*[pa.array(c[:upto][good]) for c in held[:3]], pa.array(crowd[good].astype(np.int32)), pa.array(sure[good] > 0)], ["sig", "doc_id", "n", "crowd", "hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch[n].to_numpy() for n in names]
            held = own if held is None else [np.append(h, c) for h, c in zip(held, own, strict=True)]
            starts = np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1]))
            last, upto = held[0][-1], int(starts[-1])
            if len(held[0]) - upto >= COUNTED or last == large:
                yield from ready(len(held[0]), starts)
                held, large = [h[:0] for h in held], last
            else:
                if upto:
                    yield from ready(upto, starts[:-1])
                held = [h[upto:] for h in held]
        if held is not None and len(held[0]):
            yield from ready(len(held[0]), np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1])))

    return spread(parts.withColumn("hot", F.col("sure") > 0)).select(*names).mapInArrow(scan, "sig long, doc_id long, n int, crowd int, hot boolean")


def met(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, sig and short of rows (sig, doc_id, hot, n, short), grouped as in candidates: of small groups pairs in which the smaller keeps the part
    as short, and the larger too if they are equal; of crowds (centre, id) with the part and whether it is short for the id.
    """
    names = ["sig", "doc_id", "hot", "n", "short"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sig, doc, _, n, short), starts, sizes, crowd, centre in grouped(batches, names, CROWD):
            x, y = _pairs(starts[~crowd], sizes[~crowd])
            less, equal = n[x] < n[y], n[x] == n[y]
            role = np.where(less, short[x], np.where(equal, short[x] & short[y], short[y]))
            good = role & (100 * np.minimum(n[x], n[y]).astype(np.int64) >= percent * np.maximum(n[x], n[y]).astype(np.int64))
            x, y = x[good], y[good]
            z = np.flatnonzero(np.repeat(crowd, sizes))
            of = np.repeat(centre, sizes)[z]
            a, b, at = np.concatenate([doc[x], of]), np.concatenate([doc[y], doc[z]]), np.concatenate([x, z])
            pair = np.arange(len(a)) < len(x)
            for k in range(0, len(a), 50_000):
                s = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(a[s]), pa.array(b[s]), pa.array(sig[at[s]], mask=pair[s]), pa.array(short[at[s]], mask=pair[s])], ["a", "b", "sig", "short"])

    return spread(rows.select(*names)).mapInArrow(scan, "a long, b long, sig long, short boolean")


def compared(rows: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) within the groups of rows (group, doc_id, component, major) between documents of different components, in blocks.

    Documents that aren't major are compared with all, major ones not with each other. sets: doc_id and s. Blocks have BLOCK shingles and DOCS
    documents or so; a row has the numbers of two blocks, and the sets come to it by a join.
    """
    known = rows.join(sets.select("doc_id", "s", "n"), "doc_id")
    sizes = known.groupBy("group", "major").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count(F.lit(1)) / DOCS)).cast("int").alias("blocks"))
    sizes = stored(sizes, "blocks")
    dealt = known.join(sizes, ["group", "major"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    blocks = stored(dealt.groupBy("group", "major", "block").agg(F.collect_list(F.struct("doc_id", "component", "s")).alias("docs")), "blocks")
    minor = sizes.where("NOT major").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    other = sizes.select("group", "major", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    both = minor.join(other, "group").where("major OR i <= j")
    left = blocks.where("NOT major").select("group", F.col("block").alias("i"), F.col("docs").alias("docs_i"))
    right = blocks.select("group", "major", F.col("block").alias("j"), F.col("docs").alias("docs_j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = not batch["major"][k].as_py() and batch["i"][k] == batch["j"][k]
                docs = batch["docs_i"][k].as_py() + ([] if same else batch["docs_j"][k].as_py())
                first = len(batch["docs_i"][k])
                ids, parts = np.array([d["doc_id"] for d in docs]), np.array([d["component"] for d in docs])
                each = [np.frombuffer(d["s"], np.uint64) for d in docs]
                sizes = np.array([len(x) for x in each])
                _, place, often = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
                use = np.cumsum(often > 1) - 1
                owner, good = np.repeat(np.arange(len(each)), sizes), often[place] > 1
                has = np.zeros((len(each), int((often > 1).sum())), np.float32)
                has[owner[good], use[place[good]]] = 1
                inter = has[:first] @ has[0 if same else first :].T
                rest = slice(0 if same else first, None)
                x, y = np.nonzero((100 * inter >= percent * (sizes[:first, None] + sizes[None, rest] - inter)) & (parts[:first, None] != parts[None, rest]))
                y = y + rest.start
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], ["a", "b"])

    return both.join(left, ["group", "i"]).join(right, ["group", "major", "j"]).select("i", "j", "major", "docs_i", "docs_j").mapInArrow(compare, "a long, b long").distinct()


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The classes of docs, and the links between their representatives (a < b): all but some inside a component."""
    with lean(docs.sparkSession):
        return _links(docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull()), percent)


def _sampled(rows: DataFrame, n: int) -> DataFrame:
    """SAMPLE of n rows or so, by the hash of doc_id."""
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // SAMPLE)))) == 0)


def _links(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    own = stored(classes(docs), "classes")
    of = lambda c: own.select(F.col("doc_id").alias(c), F.col("rep").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"))

    def between(pairs: DataFrame) -> DataFrame:
        """Pairs of different representatives whose sizes allow a link."""
        known = pairs.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return known.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()

    # of equal sets one is sketched: copies would meet in every part and crowd it
    copies = stored(own.where("doc_id <> rep").select("doc_id"), "copies")
    texts, n, n_copies = docs, own.count(), copies.count()
    if n_copies <= BROADCAST_IDS:  # with more, copies are sketched with the rest, which links the same and spares a shuffle of the texts
        docs, n = docs.join(F.broadcast(copies), "doc_id", "left_anti"), n - n_copies

    # 1: partners share the published parts that the smaller set has to spare and one more, in small groups or in crowds
    hot = crowds(sketches(_sampled(docs, n)).select("sig"))
    sure = np.sort(np.array([r["sig"] for r in hot.select("sig").collect()], np.int64))
    found = stored(candidates(sketches(docs, sure)).groupBy("a", "b", "band", "crowd", "sig").agg(F.count(F.lit(1)).alias("n")), "candidates")
    lost = stored(found.where("crowd").groupBy(F.col("b").alias("doc_id"), "band").agg(F.sum("n").alias("n")), "lost")
    centres = found.where("sig IS NOT NULL")
    first_centre = centres.groupBy("sig").agg(F.min("a").alias("m"))
    more = centres.join(first_centre, "sig").where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"), "band", F.lit(0).cast("long").alias("n")).distinct()
    spare = lambda n: F.floor(F.lit(SLACK) * (F.floor(n / 3) + 1) - 1e-9)
    seen = found.where("a <> b").select("a", "b", "band", F.when(F.col("crowd"), 0).otherwise(F.col("n")).alias("n")).unionByName(more).groupBy("a", "b", "band").agg(F.sum("n").alias("n"))
    crowded = lambda c: lost.select(F.col("doc_id").alias(c), "band", F.col("n").alias(f"l{c}"))
    seen = seen.join(crowded("a"), ["a", "band"], "left").join(crowded("b"), ["b", "band"], "left").join(of("a"), "a").join(of("b"), "b")
    enough = F.col("n") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))) > spare(F.least("na", "nb"))
    first = stored(between(seen.where(enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "pairs")
    # the partners of a document have three quarters of its shingles at least
    poor = lost.join(own, "doc_id").where(F.col("n") > spare(F.ceil(F.col("n_shingles") * percent / 100))).select(F.col("rep").alias("doc_id")).distinct()
    poor = stored(poor, "poor")
    n_poor = poor.count()
    nodes = first.select(F.col("a").alias("doc_id")).unionByName(first.select(F.col("b").alias("doc_id"))).unionByName(poor).distinct()
    sets = stored(hashes(texts, stored(nodes, "nodes")), "sets")
    good = stored(verified(sets, first, percent), "links")
    if not n_poor:
        return own, good
    # 2: the rarest shingles
    some = sets.join(poor, "doc_id", "left_semi")
    parts = shared(single(some, crowds(single(_sampled(some, n_poor)).select("sig")).toArrow()))
    mine = Window.partitionBy("doc_id")
    ranked = parts.withColumns({"place": F.row_number().over(mine.orderBy("crowd", "sig")), "others": F.count(F.lit(1)).over(mine)})
    place, n = F.col("place") + F.col("n") - F.col("others"), F.col("n")
    kept = ranked.where(place <= n - F.ceil(n * percent / 100) + 1).withColumn("short", place <= n - F.ceil(2 * percent * n / (100 + percent)) + 1)
    again = stored(met(kept, percent).distinct(), "candidates")
    crowd = again.where("sig IS NOT NULL")
    top = stored(crowd.groupBy("sig").agg(F.min("a").alias("group")), "centres")
    crowd = crowd.join(top, "sig")
    stars = crowd.select(F.col("group").alias("a"), F.col("a").alias("b")).where("a < b")
    meeting = again.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(stars).where("a <> b").distinct()
    second = stored(between(meeting).join(first, ["a", "b"], "left_anti"), "pairs")
    good = stored(good.unionByName(verified(sets, second, percent)), "links")
    # 3: crowds of more than one component
    rows = crowd.groupBy("group", F.col("b").alias("doc_id")).agg(F.bool_or("short").alias("short"))
    rows = rows.join(components(good).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = stored(rows, "crowded")
    each = rows.groupBy("group", "component").agg(F.count(F.lit(1)).alias("k"), F.bool_or("short").alias("short"))
    several = each.groupBy("group").agg(F.count(F.lit(1)).alias("parts"), F.bool_or("short").alias("short"), F.max(F.struct("k", "component")).alias("m"))
    several = stored(several.where("parts > 1 AND short").select("group", F.col("m.component").alias("largest")), "several")
    rest = stored(rows.join(several, "group").select("group", "doc_id", "component", (F.col("component") == F.col("largest")).alias("major")), "rest")
    if rest.isEmpty():
        return own, good
    return own, good.unionByName(compared(rest, sets, percent))


def joined(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each doc_id."""
    own, good = links(docs, percent)
    with lean(docs.sparkSession):
        whole = components(good).select(F.col("node").alias("rep"), "component")
    return own.join(whole, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, of the smallest doc_id in each component; rows without a doc_id stay, too.

    Of rows with one doc_id the longest text stays, of equally long ones the smallest.
    """
    dropped = stored(joined(docs, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__id")), "dropped")
    key = F.col("doc_id").cast("long")
    again = stored(docs.where(key.isNotNull()).groupBy(key.alias("__id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id"), "repeated")
    kept = docs.join(dropped, key == F.col("__id"), "left_anti")
    if again.isEmpty():
        return kept
    same = kept.join(again, key == F.col("__id"), "left_semi").withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(F.length("text")), "text")))
    return kept.join(again, key == F.col("__id"), "left_anti").unionByName(same.where("__r = 1").drop("__r"))
