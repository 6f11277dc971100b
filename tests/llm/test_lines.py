"""Line dedup: the cuckoo filter, insertions and deletions against a plain rule, and runs that were cut off."""

import os
import random

import numpy as np
import pytest

from sparkloom.llm.cuckoo import Cuckoo
from sparkloom.llm.lines import LineIndex, key_of

SPACE = " \t\n\x0b\x0c\r"


def test_cuckoo_loses_nothing_and_forgets_what_goes():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (30_000, 2)).astype(np.uint64)
    f = Cuckoo.sized(1000)  # far too small: it has to widen
    for part in np.array_split(keys, 7):
        f.add(part)
    assert f.has(keys).all() and len(f) == len(keys)
    other = rng.integers(0, 1 << 63, (30_000, 2)).astype(np.uint64)
    again = Cuckoo.read(f.write())
    assert (again.table == f.table).all()
    gone = rng.random(len(keys)) < 0.5
    again.remove(keys[gone])
    assert again.has(keys[~gone]).all() and len(again) == (~gone).sum()
    again.remove(keys[~gone])
    assert len(again) == 0 and not again.has(keys).any()
    sized = Cuckoo.sized(30_000)
    sized.add(keys)
    assert sized.table.shape[1] == 4 and sized.has(keys).all() and sized.has(other).mean() < 0.001
    with pytest.raises(ValueError):
        Cuckoo.sized(10).remove(keys[:1])


def test_cuckoo_with_equal_fingerprints_in_one_bucket():
    keys = np.array([[5, 8 * i] for i in range(40)], np.uint64)  # the same fingerprint; with 8 buckets, the same bucket
    f = Cuckoo.sized(20)
    f.add(keys)
    assert len(f) == 40 and f.has(keys).all()
    f.remove(keys[:39])
    assert len(f) == 1 and f.has(keys[39:]).all()


def plain(rows, least_docs=3, least_chars=20):
    """{key: documents}, and the texts without repeated lines."""
    key = lambda s: "".join(c.lower() if c.isascii() else c for c in s.strip(SPACE))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        low = lambda d: (d is not None, d or 0)
        kept = [s for s in lines if not (len(found := holders.get(key(s), ())) >= least_docs and max(found, key=low) != i)]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return holders, sorted(out, key=repr)


def cleaned(index, docs, **options):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in index.clean(docs, **options).collect()), key=repr)


def counts(index):
    return {bytes(r["key"]): (r["n"], r["doc"]) for r in index.refs().collect()}


def corpus(seed, ids, pool=40):
    rng = random.Random(seed)
    lines = [f"A line that {'é' * rng.randrange(3)} documents share, number {i}" for i in range(pool)] + ["", "short", " \t", "x" * 20, "y" * 19]
    change = lambda s: rng.choice((s, f"  {s}\t", s.upper() if s.isascii() else s, s + "\r"))
    return [(i, "\n".join(change(rng.choice(lines)) if rng.random() < 0.6 else f"own line {i} {k} {rng.random()}" for k in range(rng.randrange(0, 12)))) for i in ids]


DOCS = "doc_id long, text string"


def test_insertions_and_deletions_equal_the_plain_rule(spark, tmp_path):
    rows = corpus(3, range(120))
    index = LineIndex(spark, str(tmp_path / "i"), keys_per_shard=20)
    state = []
    for part in (rows[:50], rows[50:51], rows[51:]):
        index.insert(spark.createDataFrame(part, DOCS))
        state += part
        holders, want = plain(state)
        docs = spark.createDataFrame(state, DOCS)
        assert cleaned(index, docs) == want == cleaned(index, docs, filter_bytes=0)
        assert counts(index) == {key_of(k): (len(d), max(d)) for k, d in holders.items()}
    before = counts(index)
    gone = [119, 118, 117, 60, 3]
    index.delete(spark.createDataFrame([(i,) for i in [*gone, 5000]], "doc_id long"))
    state = [r for r in rows if r[0] not in gone]
    holders, want = plain(state)
    assert counts(index) == {key_of(k): (len(d), max(d)) for k, d in holders.items()}
    again = LineIndex(spark, str(tmp_path / "i"))  # opened anew, from its folder
    assert cleaned(again, spark.createDataFrame(state, DOCS)) == want
    again.insert(spark.createDataFrame([r for r in rows if r[0] in gone], DOCS))
    assert counts(again) == before
    with pytest.raises(ValueError):
        again.insert(spark.createDataFrame(rows[:1], DOCS))
    for r in again.filters().collect():  # what the filters hold is what the counts say
        assert Cuckoo.read(bytes(r["seen"])).used.sum() >= Cuckoo.read(bytes(r["repeated"])).used.sum()
    again.reshard()
    assert counts(again) == before and sum(len(Cuckoo.read(bytes(r["seen"]))) for r in again.filters().collect()) == len(before)
    assert sum(len(Cuckoo.read(bytes(r["repeated"]))) for r in again.filters().collect()) == sum(n >= 3 for n, _ in before.values())


def test_everything_deleted_leaves_empty_filters(spark, tmp_path):
    rows = corpus(4, range(30))
    index = LineIndex(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame(rows, DOCS)
    index.insert(docs)
    index.delete(docs)
    assert counts(index) == {} and index.holders().isEmpty()
    assert all(len(Cuckoo.read(bytes(r[c]))) == 0 for r in index.filters().collect() for c in ("seen", "repeated"))
    index.insert(docs)
    assert cleaned(index, docs) == plain(rows)[1]


def test_a_run_that_was_cut_off_leaves_the_index_as_it_was(spark, tmp_path):
    rows = corpus(5, range(40))
    index = LineIndex(spark, str(tmp_path / "i"))
    index.insert(spark.createDataFrame(rows[:30], DOCS))
    before = counts(index)
    broken = LineIndex(spark, str(tmp_path / "i"))
    broken._commit = lambda *a, **b: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        broken.insert(spark.createDataFrame(rows[30:], DOCS))
    assert len(os.listdir(tmp_path / "i")) == 3  # two versions and the commits: the second was never committed
    again = LineIndex(spark, str(tmp_path / "i"))
    assert counts(again) == before
    again.insert(spark.createDataFrame(rows[30:], DOCS))
    assert cleaned(again, spark.createDataFrame(rows, DOCS)) == plain(rows)[1]


def test_defined_cases(spark, tmp_path):
    line = "the same line in all of these documents"
    rows = [(1, f"{line}\nown"), (None, f"{line}\n{line}"), (None, line), (7, f"{line}\n {line.upper()}\nlast"), (7, line), (8, None), (9, ""), (10, "\n\n"), (11, f"{line}{'z' * 300_000}\n" * 2)]
    extra = [(i, t, "a", 3, b"k") for i, t in rows]
    docs = spark.createDataFrame(extra, "doc_id long, text string, key string, n_lines int, doc binary")
    index = LineIndex(spark, str(tmp_path / "i"))
    index.insert(docs)
    out = index.clean(docs)
    assert out.columns == ["doc_id", "text", "key", "doc", "n_lines", "n_dropped"]
    assert cleaned(index, docs) == plain(rows)[1]
    empty = LineIndex(spark, str(tmp_path / "e"))
    none = docs.limit(0)
    assert empty.clean(none).count() == 0
    empty.insert(none)
    empty.delete(none)
    assert empty.clean(none).count() == 0 and counts(empty) == {}
    empty.insert(docs)
    assert cleaned(empty, docs) == plain(rows)[1]
