"""N-gram Jaccard join: exact links between documents whose sets of word n-grams are similar, and their components.

A document's set is ordered by one global order: n-grams that many documents share come last, others by their hash. Two sets that are
similar enough share an n-gram among their first n - ceil(t * n) + 1 (prefix filtering), so only prefixes are dealt out, by n-gram. Equal sets
are one node from the start. In a task, the sets with an n-gram in common form a list, and three bounds sort out pairs: the sizes, what is left
after the n-gram's positions in both sets, and the number of prefix n-grams that a set shares with any other. None of them loses a link.

Candidates are compared in two rounds, and never as all pairs of a list. First each set is held against the leader of its lists (the set
in which the shared n-gram stands earliest, usually the origin of a family of copies) and against its partner where just two share an n-gram.
Components of the links found merge most lists into one; only pairs of a list that are still in different components are compared in the second
round. A set's texts meet its leader's in a prefix tree: the candidates' ordered n-grams are stored in a trie, the leader's set goes down it once,
candidates that begin alike share the overlap counted so far, and a branch is left as soon as the n-grams that remain on either side can't reach the threshold.

Scale: documents are read twice for their n-grams (the order's statistics cover all of them) and texts travel only for candidates. The rows of the texts wanted are
broadcast while their table is below broadcast_bytes and joined by a shuffle beyond. Lists come to a task sorted by Spark and are read run by run: what is held at a time is POSTED
postings, and a longer list is read in pieces that know its leader. In the second round a list of more than BLOCK members is dealt out by pairs of salted blocks, so that every pair of members meets
in one group and no group has more than about two blocks. Tables between the steps are written, so a lost executor costs its own tasks. Texts come to Python
some megabytes at a time.

Sets and n-grams are 63- and 64-bit hashes; the comparison itself is exact on them. Defined cases: a null text, or one without words, has an empty set and is linked with nothing; with fewer
than n words the whole sequence is the one n-gram; repeated rows and equal texts are linked; words and texts of any length are taken whole; rows are told apart by id and text, so rows with one id and different texts are linked
each by its own text, and rows without an id link as others do (a component has the least id of its rows, null if none has one); an empty table
gives no rows; only the id and text columns are read by sets() and components().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, small_batches
from sparkloom.llm.components import connected
from sparkloom.llm.trie import NgramTrie

CHUNK = 2_000_000  # n-grams counted together in a task
POSTED = 400_000  # postings that a task holds at a time, beside a dozen arrays of as many numbers
SEEN = 100_000  # pairs that a task remembers to hand on once
EMITTED = 20_000  # pairs that a task hands on at once
BLOCK = 2000  # members of a list compared with each other in the second round
LAST = np.uint64(1 << 63)  # on an n-gram that many documents share: it comes last
LOCALLY_COMMON, COMMON, MOST_COMMON = 3, 50, 200_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Ascending distinct 63-bit hashes of each text's n-grams. A-Z are lower-cased; words end at ASCII white space."""
    from xxhash import xxh3_64_intdigest

    words = [(t or "").encode().lower().split() for t in texts]
    counts = [len(w) for w in words]
    flat = np.fromiter((xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, sum(counts))
    grams = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for i in range(n):
        grams = _mixed(grams * _MIX[0] + flat[i : i + len(grams)])
    grams >>= np.uint64(1)
    out, at = [], 0
    for ws, count in zip(words, counts):
        if count >= n:
            out.append(np.unique(grams[at : at + count - n + 1]))
        else:
            out.append(np.array([xxh3_64_intdigest(b" ".join(ws), seed=count) >> 1], np.uint64) if count else np.array([], np.uint64))
        at += count
    return out


def ordered(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set in the global order, its common n-grams last; ascending as numbers too."""
    if not len(common) or not len(grams):
        return grams
    last = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
    return np.concatenate([grams[~last], grams[last] | LAST])


def least_overlap(nx, ny, percent: int):
    """The n-grams that sets of these sizes must share."""
    return -(-percent * (nx + ny) // (100 + percent))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _sets_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Rows with their sets and these sets' identities, some hundred rows at a time."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = ngram_sets(part.column(1).to_pylist(), n)
            yield part, sets, np.fromiter((xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets))


def sets(docs: DataFrame, n: int) -> DataFrame:
    """Rows (id, row, size, set_id) for documents, with size 0 and no set_id for empty ones, and rows (gram, times) for n-grams
    that several sets of a chunk have. Both in one table, as one reading of the texts gives both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "row", "size", "set_id", "gram", "times"]
        chunk: dict[int, np.ndarray] = {}
        held = 0

        def common() -> pa.RecordBatch:
            flat = np.concatenate(list(chunk.values()))
            chunk.clear()
            flat.sort()
            starts = _runs(flat)
            times = np.diff(np.append(starts, len(flat)))
            often = times >= LOCALLY_COMMON
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), _signed(flat[starts[often]]), pa.array(times[often], pa.int64())], names=names)

        for part, found, keys in _sets_of(batches, n):
            sizes = [len(s) for s in found]
            k = len(found)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(sizes, pa.int32()), pa.array(keys.view(np.int64), pa.int64(), mask=np.array(sizes) == 0), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names
            )
            for s, key in zip(found, keys.tolist()):
                if len(s) and key not in chunk:
                    chunk[key] = s
                    held += len(s)
            if held >= CHUNK:
                yield common()
                held = 0
        if chunk:
            yield common()

    return docs.mapInArrow(run, "id long, row long, size int, set_id long, gram long, times long")


def postings(docs: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """(gram, set_id, place) for the prefix of each set; place is the n-gram's position in the set * 2^32 + the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, found, keys in _sets_of(batches, n):
            grams, owners, places = [], [], []
            for s, key in zip(found, keys.tolist()):
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                prefix = ordered(s, common)[: prefix_length(len(s), percent)]
                grams.append(prefix)
                owners.append(np.full(len(prefix), key, np.uint64))
                places.append((np.arange(len(prefix)) << 32) + len(s))
            if len(seen) > 50_000:
                seen.clear()
            if grams:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(grams)), _signed(np.concatenate(owners)), pa.array(np.concatenate(places), pa.int64())], names=["gram", "set_id", "place"])

    return docs.mapInArrow(run, "gram long, set_id long, place long")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, for sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _may_link(px: np.ndarray, py: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets at these places of a shared n-gram can be similar, if it is the first they share."""
    at_x, at_y, nx, ny = px >> 32, py >> 32, px & 0xFFFFFFFF, py & 0xFFFFFFFF
    return (percent * np.maximum(nx, ny) <= 100 * np.minimum(nx, ny)) & (np.minimum(nx - at_x, ny - at_y) >= least_overlap(nx, ny, percent))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int, chunk: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Sorted rows as arrays by column, some whole runs of equal first columns at a time; a run of more than chunk rows comes in pieces, all but the last with True."""
    held: list[list[np.ndarray]] = []
    n = 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held)]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n >= chunk:
            rows = joined()
            last = int(_runs(*rows[:keys])[-1])
            # What goes on is a copy, so that the rows handed out are held no longer than they are used.
            held, n = ([[c[last:].copy() for c in rows]], n - last) if last else ([], 0)
            rows = [c[: last or len(c)] for c in rows]
            yield rows, not last
            del rows
    if n:
        yield joined(), False


def gather(posted: DataFrame, percent: int, chunk: int = POSTED) -> DataFrame:
    """What the lists give: rows "pair" (x, y: the two sets that share times n-grams with nobody else), "star" (x leads y),
    "member" (list x has set y at this place) and "shared" (set x shares times n-grams, of which place stand in lists)."""

    def rows(kind: str, x: np.ndarray, y: np.ndarray | None, at: np.ndarray | None, times: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(x), 100_000):
            c = [pa.array(v[i : i + 100_000], pa.int64()) if v is not None else pa.nulls(len(x[i : i + 100_000]), pa.int64()) for v in (x, y, at, times)]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(c[0])), *c], names=["kind", "x", "y", "place", "times"])

    def lists(gram: np.ndarray, place: np.ndarray, owner: np.ndarray, leader: tuple[int, int] | None, long: bool) -> Iterator[pa.RecordBatch]:
        """Of whole lists, or of a piece of a long one, whose leader is given but for the first piece."""
        starts = _runs(gram)
        lengths = np.diff(np.append(starts, len(gram)))
        length, first = np.repeat(lengths, lengths), np.repeat(starts, lengths)
        if long:
            length = np.full(len(gram), 1 << 40)
        lead_owner, lead_place = owner[first], place[first]
        if leader:
            lead_owner, lead_place = np.full(len(gram), leader[0]), np.full(len(gram), leader[1])
        follows = (length >= 2) & ((np.arange(len(gram)) != first) | (leader is not None))
        near = follows.copy()
        near[follows] = _may_link(lead_place[follows], place[follows], percent)
        for kind, mask in (("pair", follows & (length == 2)), ("star", near & (length > 2))):
            x, y = lead_owner[mask], owner[mask]
            if kind == "pair":
                x, y = np.minimum(x, y), np.maximum(x, y)
            o = np.lexsort((y, x))
            at = _runs(x[o], y[o])
            yield from rows(kind, x[o][at], y[o][at], None, np.diff(np.append(at, len(o))))
        shared = np.flatnonzero(length >= 2)
        if len(shared):
            o = shared[np.argsort(owner[shared], kind="stable")]
            at = _runs(owner[o])
            yield from rows("shared", owner[o][at], None, np.add.reduceat((length[o] > 2).astype(np.int64), at), np.diff(np.append(at, len(o))))
        listed = np.flatnonzero(length > 2)
        if len(listed):
            begin = _runs(gram[listed])
            ids = gram[listed].copy()
            if not long:
                ids = np.add.reduceat(_mixed(owner[listed].view(np.uint64)), begin)  # the same for the same members
                ids = np.repeat(ids, np.diff(np.append(begin, len(listed)))).view(np.int64)
            o = np.lexsort((place[listed], owner[listed], ids))
            o = o[_runs(ids[o], owner[listed][o])]  # of equal lists, each member's earliest place
            yield from rows("member", ids[o], owner[listed][o], place[listed][o], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, last, long = None, None, False
        for (gram, place, owner), more in whole_runs(batches, 1, chunk):
            new = _runs(gram, place, owner)  # a set once for each n-gram
            if long and (gram[0], place[0], owner[0]) == last:
                new = new[1:]
            last = (gram[-1], place[-1], owner[-1])
            gram, place, owner = gram[new], place[new], owner[new]
            begin = 0
            if long:  # what goes before belongs to the long list
                begin = int(np.searchsorted(gram != leader[2], True))
                yield from lists(gram[:begin], place[:begin], owner[:begin], leader[:2], True)
                long = more and begin == len(gram)
            if begin < len(gram):
                yield from lists(gram[begin:], place[begin:], owner[begin:], None, more)
                leader, long = (int(owner[begin]), int(place[begin]), gram[begin]), more

    dealt = posted.select("gram", "place", "set_id").repartition("gram").sortWithinPartitions("gram", "place", "set_id")
    return dealt.mapInArrow(run, "kind string, x long, y long, place long, times long")


def _enough(x: str, y: str, pair: F.Column, percent: int) -> F.Column:
    """Whether the prefix n-grams that x and y can have in common reach what their sizes ask for: all shared ones up to the smaller
    prefix end are known, beyond it there are size - prefix more. pair: those that stand in no list."""
    nx, ny = F.col(f"size_{x}").cast("long"), F.col(f"size_{y}").cast("long")
    least = F.ceil((percent * (nx + ny)) / F.lit(100 + percent))
    beyond = F.ceil(percent * F.greatest(nx, ny) / F.lit(100)) - 1
    return (percent * F.greatest(nx, ny) <= 100 * F.least(nx, ny)) & (pair + F.least(F.col(f"listed_{x}"), F.col(f"listed_{y}")) + beyond >= least)


def _with_shared(edges: DataFrame, shared: DataFrame) -> DataFrame:
    for side in ("x", "y"):
        own = shared.select(F.col("set_id").alias(side), F.col("size").alias(f"size_{side}"), F.col("listed").alias(f"listed_{side}"))
        edges = edges.join(own, side)
    return edges


def cross_pairs(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs of a list's members that are in different components and pass the bounds. members: list, set_id, place, comp, shared and members (of the list)."""

    def pairs(s: np.ndarray, p: np.ndarray, c: np.ndarray, k: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        o = np.argsort(p & 0xFFFFFFFF, kind="stable")
        s, p, c, k, side = s[o], p[o], c[o], k[o], side[o]
        size = p & 0xFFFFFFFF
        stop = np.searchsorted(percent * size, 100 * size, side="right")  # sizes up to 100 / percent times as many
        both = bool(side.any())
        for i in range(len(s)):
            j = np.arange(i + 1, stop[i])
            j = j[(c[j] != c[i]) & ((side[j] != side[i]) | (not both))]
            if len(j):
                beyond = -(-percent * size[j] // 100) - 1
                j = j[_may_link(p[i], p[j], percent) & (np.minimum(k[i], k[j]) + beyond >= least_overlap(size[i], size[j], percent))]
            if len(j):
                yield np.full(len(j), s[i]), s[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        found: list[tuple[int, int]] = []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))], names=["x", "y"])

        for (g, a, b, s, p, c, k, side), _ in whole_runs(batches, 3, 100_000):
            bounds = [*_runs(g, a, b).tolist(), len(g)]
            for i, j in zip(bounds, bounds[1:]):
                for x, y in pairs(s[i:j], p[i:j], c[i:j], k[i:j], side[i:j]):
                    new = [xy for xy in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()) if xy not in seen]
                    if new:
                        if len(seen) < SEEN:
                            seen.update(new)
                        found += new
                        if len(found) >= EMITTED:
                            yield emit()
                            found.clear()
        yield emit()

    blocks = F.ceil(F.col("members") / F.lit(block))
    own = F.pmod(F.xxhash64("set_id", F.lit("block")), blocks)
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("list", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "set_id", "place", "comp", "shared", (F.col("own") > F.col("other")).cast("int").alias("side"))
    dealt = dealt.repartition("list", "a", "b").sortWithinPartitions("list", "a", "b", "set_id")
    return dealt.mapInArrow(run, "x long, y long").distinct()


def compare(edges: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int, common: np.ndarray, broadcast_bytes: int) -> DataFrame:
    """The edges (x, y) whose sets are similar. reps: set_id, and id and row of a document with it. docs: id, text and row."""
    reps = reps.select("set_id", F.col("id").alias("_id"), F.col("row").alias("_row"))
    wanted = materialize(edges.select(F.explode(F.array("x", "y")).alias("set_id")).distinct().join(reps, "set_id"), "jaccard-wanted")
    size = _bytes(wanted)
    found = docs.join(F.broadcast(wanted) if size <= broadcast_bytes else wanted, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")))
    texts = found.groupBy("set_id").agg(F.first("text").alias("text"))  # repeated rows once
    first, second = texts.withColumnsRenamed({"set_id": "x", "text": "text_x"}), texts.withColumnsRenamed({"set_id": "y", "text": "text_y"})
    rows = edges.select("x", "y").join(second, "y").join(first, "x").select("x", "y", "text_x", "text_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bounds = [*_runs(np.array(x)).tolist(), len(x)] if x else [0]
            found = []
            for a, b in zip(bounds, bounds[1:]):
                for at in range(a, b, 512):
                    few = slice(at, min(b, at + 512))
                    trie = NgramTrie()
                    for key, s in zip(y[few], ngram_sets([batch.column(3)[i].as_py() for i in range(few.start, few.stop)], n)):
                        trie.insert(ordered(s, common), key)
                    own = ordered(ngram_sets([batch.column(2)[at].as_py()], n)[0], common)
                    found += [(x[at], key) for key, _ in trie.similar(own, percent)]
            columns = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["x", "y"])

    return rows.mapInArrow(run, "x long, y long")


def _bytes(table: DataFrame) -> int:
    """Of a written table's files."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in table.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per document id, size (of its set) and component (the smallest id that links lead to, its own included)."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("row"))
    with small_batches(docs.sparkSession):
        read = materialize(sets(docs, n), "jaccard-sets")
        times = read.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= COMMON)
        top = times.orderBy(F.desc("times"), "gram").limit(MOST_COMMON).select("gram").collect()  # a bounded list, for the order alone
        common = np.sort(np.array([r["gram"] for r in top], np.int64).view(np.uint64))
        own = read.where("size is not null").select("id", "row", "size", "set_id")
        reps = own.where("set_id is not null").groupBy("set_id").agg(F.min("id").alias("least"), F.min(F.struct("id", "row")).alias("of"), F.first("size").alias("size"))
        reps = materialize(reps.select("set_id", "least", "of.id", "of.row", "size"), "jaccard-reps")

        found = materialize(gather(postings(docs, n, percent, common), percent), "jaccard-lists")
        shared = found.where("kind = 'shared'").groupBy(F.col("x").alias("set_id")).agg(F.sum("times").alias("shared"), F.sum("place").alias("listed"))
        shared = materialize(shared.join(reps.select("set_id", "size"), "set_id"), "jaccard-shared")
        pairs = found.where("kind = 'pair'").groupBy("x", "y").agg(F.sum("times").alias("times"))
        pairs = _with_shared(pairs, shared).where(_enough("x", "y", F.col("times"), percent)).select("x", "y")
        stars = found.where("kind = 'star'").groupBy("x", "y").agg(F.sum("times").alias("times")).groupBy("y").agg(F.max(F.struct("times", "x")).alias("m")).select(F.col("m.x").alias("x"), "y")
        first = materialize(pairs.union(stars).distinct(), "jaccard-candidates")
        links = materialize(compare(first, reps, docs, n, percent, common, broadcast_bytes), "jaccard-links")
        merged = connected(links)

        lists = found.where("kind = 'member'").select(F.col("x").alias("list"), F.col("y").alias("set_id"), "place")
        lists = lists.join(shared.select("set_id", "shared"), "set_id").join(merged.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
        lists = materialize(lists, "jaccard-members")
        open_lists = lists.groupBy("list").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("members")).where("a < b").select("list", "members")
        second = materialize(cross_pairs(lists.join(open_lists, "list"), percent), "jaccard-candidates")
        more = materialize(compare(second, reps, docs, n, percent, common, broadcast_bytes), "jaccard-links")
        merged = connected(links.union(more)) if not more.isEmpty() else merged

    roots = reps.join(merged.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    least = roots.groupBy("comp").agg(F.min("least").alias("component"))
    by_set = materialize(roots.select("set_id", "comp").join(least, "comp").select("set_id", "component"), "jaccard-components")
    whole = own.where("set_id is not null").join(by_set, "set_id").select("id", "size", "component")
    return whole.union(own.where("set_id is null").select("id", "size", F.col("id").alias("component")))
