"""The pipeline by its stages, and the queries that SQL can express."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from sparkloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_jaccard import brute as brute_components
from tests.oracle import SF_DIR, compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), ORACLE_SQL[name])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with toxic documents, near copies and a shared passage."""
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "rt", "l", "sk")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = " ".join(f"passage{i}" for i in range(60)) + "."
    docs, labels, planted = [], [], {"toxic": set(), "near": set(), "repeats": set()}
    for i in range(160):
        text = say(rng.randrange(30, 120)) + "."
        toxic = i % 5 == 0
        if toxic:
            text = " ".join(f"You {rng.choice(('snarfling', 'grobbish', 'blatherskite'))} {say(6)}." for _ in range(6))
            planted["toxic"].add(i)
        labels.append((i, 1, int(toxic)))
        docs.append((i, text, "en", rng.choice(("web", "web", "books", None))))
    base = docs[1][1].split()
    for k in range(200, 206):
        changed = list(base)
        changed[-2] = f"changed{k}"
        docs.append((k, " ".join(changed), "en", "web"))
        planted["near"].add(k)
    for k in range(300, 305):
        docs.append((k, f"{say(40)}. {passage} {say(40)}.", "en", "books"))
        planted["repeats"].add(k)
    docs += [(400, None, None, None), (401, "", "en", "web")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, planted, passage


def test_stages_do_their_work_and_keep_the_rest(spark, tables, tmp_path):
    path, planted, passage = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
        if name != "packing":
            assert docs.columns == columns
    before, after = ({r["doc_id"] for r in rows} for rows in seen["toxicity"])
    assert before - after == planted["toxic"]

    rows, kept = seen["jaccard"]
    found = brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    assert {r["doc_id"] for r in kept} == {i for i, (_, c) in found.items() if c == i}
    assert not planted["near"] & {r["doc_id"] for r in kept}

    rows, cut = seen["substring"]
    texts = {r["doc_id"]: r["text"] for r in cut}
    assert len(cut) == len(rows) and passage in texts[300] and not any(passage in (texts[k] or "") for k in (301, 302, 303, 304))
    same = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in planted["repeats"]}
    assert all(texts[i] == t for i, t in same.items())
    assert all(r["n_chars"] == len(r["text"]) for r in cut if r["text"] is not None)

    rows, mixed = seen["mixing"]
    copies = Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 2 and set(copies) <= {r["doc_id"] for r in rows}
    assert abs(sum(len((r["text"] or "").split()) for r in mixed) / sum(len((r["text"] or "").split()) for r in rows) - 1.5) < 0.1

    rows, pieces = seen["packing"]
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    assert set(tokens) == {r["doc_id"] for r in rows}
    assert all(tokens[p["doc_id"]] == copies[p["doc_id"]] * p["doc_tokens"] for p in pieces)


def test_run_on_an_empty_table(spark, tables, tmp_path):
    path, _, _ = tables
    for t in ("documents", "labels"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert "pipeline" in QUERIES and set(ORACLE_SQL) <= set(QUERIES)
